"""Column expressions over text; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def loc_nonblank(content: Column | str) -> Column:
    """Lines that have more than spaces."""
    return F.size(F.filter(F.split(_c(content), r"\r\n|\r|\n"), lambda x: F.trim(x) != "")).cast("long")
