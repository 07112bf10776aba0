"""Keyed hashing: the same number for the same seed and parts in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the hashes that sketches keep, which must tell all nodes apart, and the range they lie in.
DIGITS = 15
RANGE = float(1 << 4 * DIGITS)


def keyed(*parts: Column | str | int, digits: int = 8) -> Column:
    """The first ``digits`` hexadecimal digits of md5('a:b:...') as a BIGINT.

    8 digits do for draws and orders with a tie-break; identity needs DIGITS
    (60 bits). Built-in functions only, so it stays in generated code.
    """
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(c.cast("string") for c in columns))), 1, digits), 16, 10).cast("bigint")
