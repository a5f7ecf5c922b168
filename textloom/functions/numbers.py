"""Number functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded as SQL engines round doubles: times a power of ten, halves away from zero, and back.

    `F.round` rounds the shortest decimal that names the double instead, so that 4.0453125, whose
    double lies below the half, goes up.
    """
    scale = F.lit(float(10**digits))
    return F.round((F.col(x) if isinstance(x, str) else x) * scale) / scale
