"""Column expressions, reshaping and ordered-rank helpers shared by the operators."""
