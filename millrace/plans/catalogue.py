"""Registered queries of the general package: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from millrace.operators import curate, decontam, evaluate, grounding, nested, retrieval, stats, units

QUERIES: dict = {
    "p1_found": (nested.p1_found, None),
    "p1_nodes": (nested.p1_nodes, None),
    "p1_types": (nested.p1_types, None),
    "p4_found": (units.p4_found, None),
    "p4_values": (units.p4_values, None),
    "p4_report": (units.p4_report, None),
    "filter_funnel": (curate.filter_funnel, curate.FUNNEL_SQL),
    "papers_latest": (curate.papers_latest, curate.LATEST_SQL),
    "distilled_first": (curate.distilled_first, curate.FIRST_SQL),
    "id_window": (curate.id_window, curate.WINDOW_SQL),
    "sample_pool": (curate.sample_pool, curate.SAMPLE_SQL),
    "holdout_split": (curate.holdout_split, curate.SPLIT_SQL),
    "scaling_subsets": (curate.scaling_subsets, curate.SUBSETS_SQL),
    "review_queue": (curate.review_queue, curate.REVIEW_SQL),
    "datacard": (curate.datacard, curate.CARD_SQL),
    "resume_todo": (curate.resume_todo, curate.RESUME_SQL),
    "blacklist_recall": (curate.blacklist_recall, curate.BLACKLIST_SQL),
    "first_user": (curate.first_user, curate.USER_SQL),
    "messages": (curate.messages, None),
    "decontam_hits": (decontam.decontam_hits, decontam.HITS_SQL),
    "decontam_report": (decontam.decontam_report, decontam.REPORT_SQL),
    "decontam_clean": (decontam.decontam_clean, decontam.CLEAN_SQL),
    "decontam_splits": (decontam.decontam_splits, decontam.SPLITS_SQL),
    "bm25_topk": (retrieval.bm25_topk, retrieval.topk_sql(False)),
    "bm25_topk_excluded": (retrieval.bm25_topk_excluded, retrieval.topk_sql(True)),
    "reward_scores": (evaluate.reward_scores, None),
    "reward_gates": (evaluate.reward_gates, None),
    "validate_states": (evaluate.validate_states, None),
    "eval_scores": (evaluate.eval_scores, None),
    "eval_report": (evaluate.eval_report, None),
    "triple_pairs": (evaluate.triple_pairs, evaluate.PAIRS),
    "triple_f1": (evaluate.triple_f1, None),
    "modality_f1": (evaluate.modality_f1, evaluate.MODALITY_SQL),
    "grounding_flags": (grounding.grounding_flags, None),
    "grounding_report": (grounding.grounding_report, None),
    "stored_flags": (grounding.stored_flags, grounding.STORED_SQL),
    "group_advantage": (stats.group_advantage, stats.ADVANTAGE_SQL),
    "dedup_rate": (stats.dedup_rate, stats.DEDUP_SQL),
    "task_entropy": (stats.task_entropy, stats.ENTROPY_SQL),
    "actions": (stats.actions, stats.ACTIONS_SQL),
    "behaviour": (stats.behaviour, stats.BEHAVIOUR_SQL),
    "mask_segments": (stats.mask_segments, stats.SEGMENTS_SQL),
}
