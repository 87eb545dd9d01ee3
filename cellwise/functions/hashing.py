"""The bucket rule of the sketches: SHA-256 of the zero-padded row number and the key, folded to 64 bits, scaled to the width.

The fold takes the first eight digest bytes as signed numbers, shifts byte b left by 8b bits and joins them by exclusive or. As a signed byte
extends its sign over all higher bits, that is the little-endian number of the eight bytes with every bit above a negative byte flipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A hash function of sketches: (key, row number) to a 64-bit whole number.
HashFunction = Callable[[Column, Column], Column]


def digest(key: Column, row: Column) -> Column:
    return F.sha2(F.concat(F.lpad(row.cast("string"), 5, "0"), key), 256)


def fold(hexdigest: Column) -> Column:
    """64-bit fold of a digest in hex. ``hexdigest`` should be a column of its own projection, as it is used many times."""
    swap = [F.substring(hexdigest, 2 * b + 1, 2) for b in range(8)]
    high = F.conv(F.concat(*[swap[b] for b in (7, 6, 5, 4)]), 16, 10).cast("bigint")
    low = F.conv(F.concat(*[swap[b] for b in (3, 2, 1, 0)]), 16, 10).cast("bigint")
    word = F.shiftleft(high, 32).bitwiseOR(low)
    out = word
    for b in range(7):
        negative = F.shiftrightunsigned(word, 8 * b + 7).bitwiseAND(F.lit(1).cast("bigint"))
        out = out.bitwiseXOR(F.shiftleft(-negative, 8 * (b + 1)))
    return out


def bucket(folded: Column, width: int) -> Column:
    return F.abs((folded / F.lit(9223372036854775807.0) * F.lit(float(width))).cast("bigint"))


def folded(keys: DataFrame, key: str, rows: int, row: str = "row", hash_function: HashFunction | None = None) -> DataFrame:
    """``keys`` once a hash row, with its ``row`` and 64-bit ``_fold``. The default takes one digest and one fold a key and row, in separate projections."""
    long = keys.withColumn(row, F.explode(F.array(*[F.lit(i) for i in range(rows)])))
    if hash_function is not None:
        return long.withColumn("_fold", hash_function(F.col(key), F.col(row)).cast("bigint"))
    hashed = long.withColumn("_digest", digest(F.col(key), F.col(row)))
    return hashed.withColumn("_fold", fold(F.col("_digest"))).drop("_digest")


def spread(keys: DataFrame, key: str, rows: int, width: int, row: str = "row", col: str = "col", hash_function: HashFunction | None = None) -> DataFrame:
    """``keys`` once a hash row, with its ``row`` and ``col``."""
    return folded(keys, key, rows, row, hash_function).withColumn(col, bucket(F.col("_fold"), width)).drop("_fold")
