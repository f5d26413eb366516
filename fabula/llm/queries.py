"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, decontaminate, exact_dedup, html_extract, licenses, near_dedup, substring_dedup, token_counts, toxicity, warc

QUERIES: dict[str, Callable] = {
    "op1_toxicity": toxicity.op1,
    "op2_license_scan": licenses.op2,
    "op3_substring_dedup": substring_dedup.op3,
    "op4_html_text": html_extract.op4,
    "op5_token_counts": token_counts.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_warc_derivatives": warc.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_near_dedup": near_dedup.op9,
    "op10_bpe": bpe.op10,
}

SQL: dict[str, str] = {
    "op2_license_scan": licenses.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op9_near_dedup": near_dedup.SQL,
}
