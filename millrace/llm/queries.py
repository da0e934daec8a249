"""Registered queries of this subpackage: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from millrace.llm import calibrate, canonical, encode, leakage, markup, overlap, sentences, truncation

QUERIES: dict = {
    "p2_found": (truncation.p2_found, None),
    "p2_scores": (truncation.p2_scores, None),
    "p2_report": (truncation.p2_report, None),
    "p3_found": (markup.p3_found, None),
    "p3_clean": (markup.p3_clean, None),
    "p3_report": (markup.p3_report, None),
    "p5_found": (overlap.p5_found, None),
    "p5_pairs": (overlap.p5_pairs, None),
    "p5_report": (overlap.p5_report, None),
    "p6_found": (canonical.p6_found, None),
    "p6_unmatched": (canonical.p6_unmatched, None),
    "p7_found": (calibrate.p7_found, calibrate.FOUND_SQL),
    "p7_report": (calibrate.p7_report, None),
    "p7_sample": (calibrate.p7_sample, None),
    "p8_ids": (encode.p8_ids, None),
    "p9_found": (leakage.p9_found, None),
    "p9_items": (leakage.p9_items, None),
    "p10_found": (sentences.p10_found, None),
    "p10_counts": (sentences.p10_counts, None),
}
