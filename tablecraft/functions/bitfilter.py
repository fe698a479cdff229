"""A bit filter of hashes, of fixed size, put together by an aggregate and broadcast.

Rows whose hash is not in it are known not to be meant; up to as many hashes as it has room for few others pass
by chance, beyond more do. So what passes is always compared in full afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes that a filter has room for, with BITS_PER_HASH each; it is broadcast as 64-bit words.
ROOM = 1_000_000
BITS_PER_HASH = 16


def _place(hashed: Column, room: int) -> tuple[Column, Column]:
    """Word and bit of a hash in the filter."""
    bits = 1 << (BITS_PER_HASH * room - 1).bit_length()
    place = F.pmod(hashed, F.lit(bits))
    return F.floor(place / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def passing(
    df: DataFrame, hashed: Column, hashes: DataFrame, pass_on: bool = True, room: int = ROOM
) -> DataFrame:
    """Rows whose hash may be in the column ``__hash`` of ``hashes`` or, without ``pass_on``, those whose is not."""
    word, bit = _place(F.col("__hash"), room)
    words = hashes.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    mine, my_bit = _place(hashed, room)
    met = (mine == F.col("__word")) & (F.col("__bits").bitwiseAND(my_bit) != 0)
    return df.join(F.broadcast(words), met, "left_semi" if pass_on else "left_anti")
