"""Label and one-hot encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, SQLTransformer, StringIndexerModel, VectorSlicer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.functions.cluster import kept, local_table
from tablecraft.functions.columns import dtype_of, is_fractional, present, present_sql, quoted, ref, require_columns
from tablecraft.functions.ordered import HELD_TEXT, running_totals, small_rows
from tablecraft.functions.reshape import melt

#: Most labels, over all columns together, that are fitted as a driver-side list.
MAX_LABELS = 100_000
#: A value is handled as frequent when more than 1/FREQUENT of the rows hold it.
FREQUENT = 1_000


def label_text(df: DataFrame, name: str) -> Column:
    """The text that stands for a value in a label index; -0.0 is the same value as 0.0."""
    return F.expr(_label_sql(df, name))


def _label_sql(df: DataFrame, name: str) -> str:
    value = present_sql(df, [name])[name]
    if is_fractional(dtype_of(df, name)):
        value = f"({value} + CAST(0 AS {dtype_of(df, name).simpleString()}))"
    return f"CAST({value} AS STRING)"


def _label_counts(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    long, slots = melt(df, cols)
    counted = long.groupBy("column", *dict.fromkeys(slots.values())).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted, slots


def categories(
    df: DataFrame, cols: Sequence[str], max_labels: int = MAX_LABELS
) -> dict[str, list] | None:
    """Distinct non-null values per column in native order, as a fitted parameter.

    Returns None when there are more than ``max_labels`` of them, or over HELD_TEXT
    characters of text for each of them.
    """
    counted, slots = _label_counts(df, cols)
    typed = list(dict.fromkeys(slots.values()))
    rows = small_rows(counted.select("column", *typed), max_labels, max_labels * HELD_TEXT)
    if rows is None:
        return None
    found: dict[str, list] = {c: [] for c in cols}
    for name, *values in rows:
        value = values[typed.index(slots[name])]
        found[name].append(value + 0.0 if isinstance(value, float) else value)
    return {c: sorted(values) for c, values in found.items()}


def _label_texts(df: DataFrame, found: dict[str, list]) -> dict[str, list[str]]:
    """Category values as Spark writes them as text, in their native order."""
    texts: dict[str, list[str]] = {}
    for name, values in found.items():
        dtype = dtype_of(df, name)
        if dtype.simpleString() == "string":
            texts[name] = values
            continue
        rows = local_table(df.sparkSession, [(v,) for v in values], f"v {dtype.simpleString()}")
        texts[name] = [r.t for r in rows.orderBy("v").select(F.col("v").cast("string").alias("t")).collect()]
    return texts


def text_stage(df: DataFrame, cols: Sequence[str], outputs: Sequence[str]) -> SQLTransformer:
    """A stage that writes the text of each value, whatever its type, for the index to look up."""
    made = [f"{_label_sql(df, name)} AS {quoted(out)}" for name, out in zip(cols, outputs)]
    return SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")


def fit_labels(
    df: DataFrame,
    cols: Sequence[str],
    inputs: Sequence[str],
    outputs: Sequence[str],
    max_labels: int = MAX_LABELS,
) -> list[StringIndexerModel] | None:
    """One label index per column over its sorted categories; NULL and unseen values come last.

    ``inputs`` are the columns to index later: the same ones or their text form.

    Text is sorted by code point, numbers and dates by value. None when there
    are too many labels for a driver-side list.
    """
    found = categories(df, cols, max_labels)
    if found is None:
        return None
    texts = _label_texts(df, found)
    return [
        StringIndexerModel.from_labels(texts[c], inputCol=i, outputCol=out, handleInvalid="keep")
        for c, i, out in zip(cols, inputs, outputs)
    ]


def _index_by_join(df: DataFrame, name: str, out: str) -> DataFrame:
    """Label index of a column with too many values for a list.

    The index of a value is its rank among the distinct values, found bucket by
    bucket. Frequent values (at most FREQUENT of them by definition) are looked
    up by broadcast, so no shuffled key of ordinary length holds more than 1/FREQUENT of
    the rows.
    """
    values = df.select(present(df, name).alias("__value")).where(F.col("__value").isNotNull())
    # Read by several jobs, so that all rows are shuffled once.
    counted = kept(values.groupBy("__value").agg(F.count(F.lit(1)).alias("__n")), "values")
    sizes = counted.agg(F.count(F.lit(1)).alias("labels"), F.sum("__n").alias("rows")).first()
    ones = counted.withColumn("__one", F.least(F.col("__n"), F.lit(1)))
    ranked = running_totals(ones, "__value", ["__one"])
    index = ranked.select(
        "__value", "__n", (F.col("cum___one") - 1).cast("double").alias("__index")
    )
    limit = (sizes["rows"] or 0) / FREQUENT
    # At most FREQUENT values of at most HELD_TEXT characters: this much may be broadcast. A
    # frequent value that is longer is joined like the others, in parts if Spark finds it skewed.
    frequent = (F.col("__n") > limit) & (F.length(F.col("__value").cast("string")) <= HELD_TEXT)
    often = index.where(frequent).drop("__n")
    seldom = index.where(~frequent).drop("__n")
    column = present(df, name)
    first = df.join(F.broadcast(often), column == F.col("__value"), "left").drop("__value")
    done = first.where(F.col("__index").isNotNull() | column.isNull()).withColumn(
        out, F.coalesce("__index", F.lit(float(sizes["labels"])))
    )
    open_rows = first.where(F.col("__index").isNull() & column.isNotNull()).drop("__index")
    rest = open_rows.join(seldom, column == F.col("__value")).withColumn(out, F.col("__index"))
    wanted = [*map(ref, df.columns), F.col(out)]
    return done.select(*wanted).unionAll(rest.select(*wanted))


def label_encode(
    df: DataFrame,
    cols: Sequence[str],
    suffix: str | None = None,
    strict: bool = True,
    max_labels: int = MAX_LABELS,
) -> DataFrame:
    """Replace values by their index among the sorted distinct values.

    NULL becomes the number of distinct values. Columns keep their place;
    ``suffix`` writes new columns instead.
    """
    valid, _ = require_columns(df, cols, strict)
    if not valid:
        return df
    temporary = {c: f"__index_{i}" for i, c in enumerate(valid)}
    texts = {c: f"__text_{i}" for i, c in enumerate(valid)}
    indexers = fit_labels(df, valid, list(texts.values()), list(temporary.values()), max_labels)
    coded = df
    if indexers is not None:
        written = {texts[c]: label_text(df, c) for c in valid}
        coded = PipelineModel(stages=indexers).transform(df.withColumns(written))
    else:
        for name, out in temporary.items():
            coded = _index_by_join(coded, name, out)
    if suffix is None:
        return coded.select(
            *[F.col(temporary[c]).alias(c) if c in temporary else ref(c) for c in df.columns]
        )
    return coded.select(
        *map(ref, df.columns), *[F.col(t).alias(c + suffix) for c, t in temporary.items()]
    )


def onehot(
    df: DataFrame,
    cols: Sequence[str],
    drop_last: bool = True,
    as_array: bool = False,
    unknown: bool = False,
    max_columns: int = 1_000,
    strict: bool = True,
) -> DataFrame:
    """0/1 columns ``<column>_<value>`` (or one array ``<column>_ohe``) per category.

    ``drop_last`` leaves out the last category; NULL is all zeros, and
    ``unknown`` adds a column that marks it. A table of more than ``max_columns``
    categories in total is not made unless the caller asks for it: raise the limit, or use
    :func:`onehot_vector`.
    """
    valid, _ = require_columns(df, cols, strict)
    if not valid:
        return df
    found = categories(df, valid, max_columns)
    if found is None:
        raise ValueError(f"more than {max_columns} categories; raise max_columns, or use onehot_vector")
    added = {}
    for name, values in found.items():
        column = present(df, name)
        dtype = dtype_of(df, name)
        kept = values[:-1] if drop_last else values
        marks = {
            f"{name}_{v}": F.coalesce(column == F.lit(v).cast(dtype), F.lit(False)).cast("int")
            for v in kept
        }
        if unknown:
            marks[f"{name}_unknown"] = column.isNull().cast("int")
        if as_array:
            added[f"{name}_ohe"] = F.array(*marks.values()).cast("array<int>")
        else:
            added.update(marks)
    return df.withColumns(added)


def fit_onehot_vector(
    df: DataFrame, cols: Sequence[str], drop_last: bool = True, max_labels: int = MAX_LABELS
) -> PipelineModel:
    """Fitted stages that add a sparse vector ``<column>_ohe`` per column.

    Categories are fixed here, so the width stays the same on later tables;
    NULL and unseen values are all zeros.
    """
    indexed = [f"__index_{i}" for i in range(len(cols))]
    texts = [f"__text_{i}" for i in range(len(cols))]
    indexers = fit_labels(df, cols, texts, indexed, max_labels)
    if indexers is None:
        raise ValueError(f"more than {max_labels} categories; raise max_labels to list them, or give hash_width")
    wide = [f"__wide_{i}" for i in range(len(cols))]
    stages: list = [text_stage(df, cols, texts), *indexers, OneHotEncoder(inputCols=indexed, outputCols=wide, dropLast=True)]
    for name, indexer, raw in zip(cols, indexers, wide):
        kept = len(indexer.labels)
        if drop_last and kept > 1:
            kept -= 1
        stages.append(VectorSlicer(inputCol=raw, outputCol=f"{name}_ohe", indices=list(range(kept))))
    return Pipeline(stages=stages).fit(df)


def onehot_vector(
    df: DataFrame,
    cols: Sequence[str],
    drop_last: bool = True,
    max_labels: int = MAX_LABELS,
    hash_width: int | None = None,
) -> DataFrame:
    """:func:`fit_onehot_vector` applied to the table it was fitted on.

    With ``hash_width`` categories are not listed but hashed to that many slots, whatever
    their number (:func:`hash_report` tells how many share one); all slots are kept.
    """
    names, _ = require_columns(df, cols)
    if hash_width is None:
        coded = fit_onehot_vector(df, names, drop_last, max_labels).transform(df)
    else:
        slots = [f"__slot_{i}" for i in range(len(names))]
        coded = hash_stage(df, names, slots, hash_width).transform(df)
        coded = slot_encoder(df.sparkSession, slots, [f"{c}_ohe" for c in names], hash_width).transform(coded)
    return coded.select(*map(ref, df.columns), *[ref(f"{c}_ohe") for c in names])


def _slot_sql(df: DataFrame, name: str, width: int) -> str:
    """Slot of a category as SQL text: 48 bits of the md5 of its text; NULL has the slot ``width``."""
    digits = f"conv(substring(md5({_label_sql(df, name)}), 1, 12), 16, 10)"
    return f"CAST(coalesce(CAST({digits} AS BIGINT) % {width}, {width}) AS DOUBLE)"


def _checked_width(width: int) -> int:
    if width < 1:
        raise ValueError("hash_width must be 1 or more")
    return int(width)


def hash_stage(df: DataFrame, cols: Sequence[str], outputs: Sequence[str], width: int) -> SQLTransformer:
    """A stage that writes the slot of each category, 0 to ``width`` - 1; it holds no list and needs no fitting."""
    width = _checked_width(width)
    made = [f"{_slot_sql(df, name, width)} AS {quoted(out)}" for name, out in zip(cols, outputs)]
    return SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")


def slot_encoder(spark: SparkSession, inputs: Sequence[str], outputs: Sequence[str], width: int) -> OneHotEncoderModel:
    """One 0/1 place per slot; the slot of NULL is all zeros. The width depends on nothing but the argument."""
    slots = spark.range(_checked_width(width)).coalesce(1).select(*[F.col("id").cast("double").alias(c) for c in inputs])
    encoder = OneHotEncoder(inputCols=list(inputs), outputCols=list(outputs), dropLast=True, handleInvalid="keep")
    return encoder.fit(slots)


def hash_encode(
    df: DataFrame, cols: Sequence[str], width: int, suffix: str | None = None, strict: bool = True
) -> DataFrame:
    """Replace values by the slot their text is hashed to; NULL becomes ``width``. ``suffix`` writes new columns."""
    valid, _ = require_columns(df, cols, strict)
    width = _checked_width(width)
    slots = {c: F.expr(_slot_sql(df, c, width)) for c in valid}
    if suffix is None:
        return df.withColumns(slots) if slots else df
    return df.withColumns({c + suffix: slot for c, slot in slots.items()}) if slots else df


def hash_report(df: DataFrame, cols: Sequence[str], width: int, strict: bool = True) -> DataFrame:
    """Per column: categories, slots in use, categories that share a slot, most categories of a slot.

    Distinct values are counted per column and slot by shuffles; none reaches the driver.
    """
    valid, _ = require_columns(df, cols, strict)
    width = _checked_width(width)
    if not valid:
        return local_table(
            df.sparkSession, [], "column string, categories long, slots_used long, sharing long, largest_slot long"
        )
    texts = df.selectExpr(*[f"{_label_sql(df, c)} AS {quoted(c)}" for c in valid])
    distinct = texts.unpivot([], [ref(c) for c in valid], "column", "text").where("text IS NOT NULL").distinct()
    digits = F.conv(F.substring(F.md5("text"), 1, 12), 16, 10).cast("long")
    filled = distinct.groupBy("column", (digits % width).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return filled.groupBy("column").agg(
        F.sum("n").alias("categories"),
        F.count(F.lit(1)).alias("slots_used"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("sharing"),
        F.max("n").alias("largest_slot"),
    )
