"""Tables of odd rows that every operator has to take."""

LONG = "word and other " * 20_000 + "end"
TEXTS = [
    None, "", " \n\t ", "one", "One one ONE two", LONG, LONG, "a b c d e f g h i j k l", "ünï cödé – 漢字 \U0001f600 ok",
    "mail me@example.com now", "same text here, twice", "same text here, twice", "x" * 5000, "\n\n\n", "a\nb\na\nb\na",
]
#: Extra columns with names that operators use inside.
EXTRA = "key string, fp long, n int, found string, row int, size long, w string, t string, kept boolean, host string, shard int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def documents(spark, texts=TEXTS):
    """Rows with a NULL in every column, a repeated row, and extra columns with clashing names."""
    rows = []
    for i, text in enumerate(texts):
        rest = ("k", 1, 2, "f", 3, 4, "w", "t", True, "h", 5) if i % 2 else (None,) * 11
        rows.append((None if i % 7 == 3 else i, text, None if i % 3 else "en", None, None if text is None else len(text), *rest))
    rows.append(rows[4])
    rows.append(rows[3])
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return documents(spark).limit(0)


def texts_of(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


def in_order(rows):
    """Rows as tuples in one order, NULL first."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))
