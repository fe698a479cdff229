"""Ordered buckets of texts, of bounded size, whatever prefixes the texts share.

Texts are compared byte by byte, so the next few bytes of a text are a digit of a number
in the same order. A bucket that is too large is split by one such digit, taken behind
all that its least and greatest text share; digits that many texts have get a bucket of
their own, which is split again by what follows. Only counts and digits are looked at;
no text is brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of a bucket that is not split further.
BUCKET_TEXTS = 20_000
#: Most buckets that are split at once, one small row each.
MOST_SPLIT = 10_000
#: A bucket is split at this many shares of its texts.
FAN = 31
#: Bits for the number of a bucket among those of one split, and splits of one number.
LEVEL_BITS, LEVELS = 6, 10
#: Bytes of a digit.
DIGIT_BYTES = 6
#: Bits of the length of a text in bytes.
LENGTH_BITS = 31


def _digit(value: Column, shared: Column) -> Column:
    """The bytes behind the first ``shared`` ones as a number; shorter texts end in zeros."""
    part = F.substring(value.cast("binary"), shared + 1, F.lit(DIGIT_BYTES))
    return F.conv(F.rpad(F.hex(part), 2 * DIGIT_BYTES, "0"), 16, 10).cast("double")


def _shared(a: Column, b: Column) -> Column:
    """How many first bytes two texts share, found bit by bit."""
    x, y = a.cast("binary"), b.cast("binary")
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(LENGTH_BITS - 1))])
    most = F.least(F.octet_length(x), F.octet_length(y))

    def longer(found: Column, step: Column) -> Column:
        end = F.when(step <= most - found, found + step)
        return F.when(F.substring(x, F.lit(1), end) == F.substring(y, F.lit(1), end), end).otherwise(found)

    return F.aggregate(steps, F.lit(0), longer)


def split_texts(df: DataFrame, value: str, labels: int, out: str = "__bucket") -> DataFrame:
    """Add the number of an ordered bucket to distinct, non-null texts, of which there are ``labels``.

    No bucket holds more than BUCKET_TEXTS texts, or 1/MOST_SPLIT of all, unless LEVELS
    splits do not do. Numbers rise with the texts, with gaps.
    """
    text = F.col(value)
    limit = max(BUCKET_TEXTS, labels // MOST_SPLIT)
    rows = df.withColumn(out, F.lit(0).cast("long"))
    for _ in range(LEVELS):
        large = (
            rows.groupBy(out)
            .agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("least"), F.max(text).alias("most"))
            .where(F.col("n") > limit)
            .select(F.col(out).alias("__of"), _shared(F.col("least"), F.col("most")).alias("__shared"))
        )
        # Fewer than MOST_SPLIT rows of two numbers, by the limit.
        found = large.collect()
        if not found:
            break
        large = df.sparkSession.createDataFrame(found, large.schema).coalesce(1)
        inside = rows.join(F.broadcast(large), F.col(out) == F.col("__of"))
        shares = F.array(*[F.lit(k / (FAN + 1)) for k in range(1, FAN + 1)])
        cuts = inside.groupBy("__of", "__shared").agg(
            F.percentile_approx(_digit(text, F.col("__shared")), shares, 1000).alias("at")
        )
        # A border before and one behind a digit keep frequent digits apart from others.
        borders = F.array_sort(F.array_distinct(F.concat("at", F.transform("at", lambda d: d + 1))))
        cuts = cuts.select("__of", "__shared", borders.alias("__cuts"))
        cuts = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema).coalesce(1)
        digit = _digit(text, F.col("__shared"))
        number = F.size(F.filter("__cuts", lambda cut: cut <= digit))
        rows = rows.join(F.broadcast(cuts), F.col(out) == F.col("__of"), "left").select(
            *df.columns, (F.shiftleft(out, LEVEL_BITS) + F.coalesce(number, F.lit(0))).alias(out)
        )
    return rows
