"""Lines as rows: the common start of line filters and line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import lines


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, no, line) with 0-based line numbers; ordinals are explicit, row order means nothing."""
    return docs.select(key, F.posexplode(lines(F.col(text))).alias("no", "line"))
