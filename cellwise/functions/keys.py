"""Text keys: ``(lat,lon,type,hour)`` in any of the written forms that reach a sketch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("lat", "lon", "type", "hour")


def key_numbers(text: Column) -> Column:
    """The four numbers of a written key as a struct of doubles, or null if the text doesn't hold exactly four finite numbers.

    Round or square brackets, blanks, trailing zeros and exponents do not matter.
    """
    parts = F.split(F.translate(text, "()[] ", ""), ",")
    values = [F.get(parts, F.lit(i)).try_cast("double") for i in range(4)]
    whole = F.size(parts) == 4
    for v in values:
        whole = whole & (F.abs(v) < F.lit(1e300))
    return F.when(whole, F.struct(*[(v + F.lit(0.0)).alias(n) for n, v in zip(PARTS, values, strict=True)]))


def key_text(lat: Column, lon: Column, kind: Column, hour: Column) -> Column:
    """The one written form of a key: four decimals, whole type and hour, no blanks."""
    return F.format_string("(%.4f,%.4f,%d,%d)", lat, lon, kind.cast("bigint"), hour.cast("bigint"))
