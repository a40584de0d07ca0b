"""The corpus operators' queries and, where SQL can state the result, their SQL."""

from __future__ import annotations

from ledgerline.llm import decontaminate, language_id, license_scan, line_dedup, near_dedup, packing, quality, substring_dedup, topk_search, warc

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_language_id": language_id.query,
    "language_of_pages": language_id.page_query,
    "op4_warc": warc.query,
    "op5_quality": quality.query,
    "op6_topk_search": topk_search.query,
    "op7_near_dedup": near_dedup.query,
    "op8_decontaminate": decontaminate.query,
    "op9_best_fit_packing": packing.query,
    "op10_line_dedup": line_dedup.query,
}
ORACLES = {
    "op1_license_scan": license_scan.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op4_warc": warc.SQL,
    "op6_topk_search": topk_search.SQL,
    "op7_near_dedup": near_dedup.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op10_line_dedup": line_dedup.SQL,
}
