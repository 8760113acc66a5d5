"""The queries of this subpackage by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from foliant.llm import bpe, brown_lm, decontam, html_extract, kn_quality, license_scan, rp_forest, sigtree, url_filter, warc

QUERIES = {
    "op1_warc_revisits": warc.query,
    "op2_benchmark_decontamination": decontam.query,
    "op3_html_extraction": html_extract.query,
    "op4_brown_lm": brown_lm.query,
    "op5_bpe_tree": bpe.query,
    "op6_embedding_near_dedup": rp_forest.query,
    "op7_url_filters": url_filter.query,
    "op8_license_scan": license_scan.query,
    "op9_ngram_jaccard_join": sigtree.query,
    "op10_kn_quality": kn_quality.query,
}
SQL = {
    "op1_warc_revisits": warc.SQL,
    "op7_url_filters": url_filter.SQL,
}
