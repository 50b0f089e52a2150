"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pgspark.llm import bpe, decontaminate, html, pii, quality, secrets, simhash, substrings, urls, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_url_filters": urls.op3_url_filters,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_warc": warc.op8_warc,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
#: The other operators cannot be written in SQL and are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": substrings.OP2_SQL}
