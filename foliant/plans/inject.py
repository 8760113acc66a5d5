"""Documents with the structures that the test tables lack, put in by a rule that SQL can repeat.

doc_id % 5: 0 appends a link and an address, 1 appends Han text with odd spacing, 2 puts a chapter heading
first, 3 makes line ends paragraph breaks and adds a page number, 4 puts a byte order mark first and repeats
a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.registry import table


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, text)."""
    t, k = F.col("text"), F.pmod(F.col("doc_id"), F.lit(5))
    text = (
        F.when(k == 0, F.concat(t, F.lit("\nsee http://example.org/p?x=1 or mail a.b@example.com now")))
        .when(k == 1, F.concat(t, F.lit(" 他说：你好 ，世界 。「 引 」 剑法,ok​")))
        .when(k == 2, F.concat(F.lit("Chapter "), F.col("doc_id").cast("string"), F.lit("\n"), t))
        .when(k == 3, F.concat(F.replace(t, F.lit("\n"), F.lit("  \n \n\n\n")), F.lit("\nPage 12\n")))
        .otherwise(F.concat(F.lit("﻿"), t, F.lit("\nsame  line\nsame  line\n"))).alias("text")
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text)


INJ = """inj AS (SELECT doc_id, source, lang, CASE doc_id % 5
 WHEN 0 THEN text || chr(10) || 'see http://example.org/p?x=1 or mail a.b@example.com now'
 WHEN 1 THEN text || ' 他说：你好 ，世界 。「 引 」 剑法,ok' || chr(8203)
 WHEN 2 THEN 'Chapter ' || doc_id || chr(10) || text
 WHEN 3 THEN replace(text, chr(10), '  ' || chr(10) || ' ' || chr(10) || chr(10) || chr(10)) || chr(10) || 'Page 12' || chr(10)
 ELSE chr(65279) || text || chr(10) || 'same  line' || chr(10) || 'same  line' || chr(10) END AS text FROM documents)"""
