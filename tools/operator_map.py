"""Write docs/OPERATORS.md: SURVEY §2 id → implementing function → query key → check."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scorelake.plans import registry  # noqa: E402

# (survey id, implementation, query keys)
MAP = [
    ("S1", "sources.files.read_csv / write_csv", ["src_csv"]),
    ("S2", "sources.files.read_csv (untyped) → operators.prepare.normalize_names", ["src_csv_survey"]),
    ("S3", "sources.files.write_csv", ["src_csv"]),
    ("S4", "sources.files.write_json / read_json, operators.audit.metrics_row", ["src_json_metrics"]),
    ("S5", "sources.files.request_documents / flatten_request", ["src_request_json"]),
    ("S6", "streaming.submissions.write_batch (four folders a batch, one commit)", ["persist_three"]),
    ("S7", "sources.testdata.* + operators.report.admin_join", ["admin_latest"]),
    ("S8", "sources.files.save_table_model / load_table_model; operators.gbt.stored_fit; operators.audit.store_pipeline", ["model_roundtrip", "audit_trees"]),
    ("S9", "sources.files.artifact_manifest (binaryFile + sha2)", ["artifact_manifest"]),
    ("S10", "sources.files.append_runs / read_runs (an experiment a folder, idempotent), operators.runs.runs_table", ["runs_log", "runs_gbt"]),
    ("P1", "operators.prepare.drop_columns", ["proj_drop"]),
    ("P2", "operators.prepare.drop_by_rule", ["proj_drop_prefix"]),
    ("P3", "operators.prepare.align", ["proj_align"]),
    ("P4", "operators.prepare.normalize_names", ["proj_rename"]),
    ("P5", "functions.columns.strip_likert_prefix / first_bracket", ["strip_prefix", "first_answer"]),
    ("P6", "functions.columns.target_code", ["target_encode"]),
    ("P7", "operators.prepare.align / missing_features", ["(unit test)"]),
    ("P8", "operators.prepare.column_about", ["(unit test)"]),
    ("P9", "operators.prepare.first_value, sources.files.flatten_request", ["first_answer", "stream_score"]),
    ("P10", "inject: left join user record, coalesce defaults", ["inject_demog"]),
    ("P11", "operators.prepare.fill_cast", ["fill_cast", "src_csv_survey"]),
    ("P12", "operators.prepare.null_profile", ["null_profile"]),
    ("P13", "operators.prepare.impute; scenario override in operators.whatif", ["imputed_payment", "counterfactual"]),
    ("P14", "orderBy(key).limit(n)", ["pick_rows"]),
    ("P15", "operators.prepare.string_columns", ["(unit test)"]),
    ("P16", "functions.columns.policy_column / with_policy", ["credit_policy"]),
    ("P17", "filter amount > 0 / = 0", ["status_filter", "kpi_all"]),
    ("P18", "operators.prepare.validation_codes / validate; quarantine in streaming.submissions", ["validate_rows", "stream_score", "stream_quarantine"]),
    ("P19", "operators.prepare.completeness", ["completeness"]),
    ("P20", "operators.prepare.complete_applicants", ["complete_applicants", "complete_consented"]),
    ("P21", "operators.prepare.merge_latest / pivot_items", ["merge_blocks"]),
    ("J1", "operators.report.admin_join", ["admin_latest", "kpi_all"]),
    ("J2", "operators.reconcile.fuzzy_map (rare-bigram prefix join), last_wins; known_name / last_entry in the stream", ["fuzzy_map", "fuzzy_last_wins", "stream_score"]),
    ("J3", "operators.reconcile.fuzzy_reconcile", ["fuzzy_reconcile"]),
    ("J4", "operators.whatif.counterfactual (scenarios side by side, keyed)", ["counterfactual"]),
    ("J5", "operators.whatif.adjusted_answers", ["item_lookup"]),
    ("J6", "operators.reconcile.vocab_gaps", ["vocab_gaps"]),
    ("G1", "operators.report.value_counts", ["target_dist"]),
    ("G2", "operators.report.admin_rows / newest; explanation documents of stored predictions", ["admin_latest", "stream_explained"]),
    ("G3", "operators.report.kpis", ["kpi_all", "kpi_latest50"]),
    ("G4", "operators.report.scenario_tier_counts", ["scenario_tiers"]),
    ("G5", "operators.whatif.stability_histogram", ["tier_stability"]),
    ("G6", "operators.whatif.pillar_scores", ["pillar_scores"]),
    ("G7", "operators.runs.compare_runs", ["runs_compare"]),
    ("G8", "mean |φ| per feature, top 15", ["global_importance"]),
    ("G9", "|φ| / max |φ| per row", ["attr_width"]),
    ("W1", "plans.model.ranked_terms; operators.scorecard.explanation (nested document)", ["topk_attr", "survey_topk_attr", "stream_explained"]),
    ("W2", "operators.report.topk_global", ["topk_importance", "gbt_importance"]),
    ("W3", "operators.report.newest", ["admin_latest"]),
    ("W4", "direction flag in plans.model.ranked_terms", ["topk_attr"]),
    ("W5", "scenario columns / unionByName of runs", ["counterfactual", "runs_log"]),
    ("F1", "functions.columns.label_clean", ["label_clean"]),
    ("F2", "functions.columns.truncate", ["truncate_label"]),
    ("F3", "functions.columns.first_word", ["first_word"]),
    ("F4", "functions.columns.fmt_fixed / fmt_signed / fmt_percent", ["fmt_pct"]),
    ("F5", "functions.columns.to_level_index / level_name", ["to_level"]),
    ("F6", "functions.columns.fmt_iso / fmt_clock / fmt_local", ["fmt_ts", "admin_latest"]),
    ("F7", "functions.columns.json_or_null", ["json_decode", "stream_score"]),
    ("F8", "functions.columns.logistic", ["scorecard_score"]),
    ("F9", "coalesce defaults", ["inject_demog"]),
    ("F10", "functions.columns.stability_marker", ["tier_stability"]),
    ("F11", "functions.columns.fmt_money", ["fmt_money"]),
    ("F12", "functions.columns.r6", ["(all value checks)"]),
    ("M1", "operators.split.stratified_split (ordered.ordered_position)", ["split_80_20"]),
    ("M2", "operators.split.stratified_split", ["split_60_20_20"]),
    ("M3", "operators.split.class_weights; operators.gbt.with_weights", ["class_weights"]),
    ("M4", "operators.encode.ordered_target_encoding; StringIndexer(keep) in operators.gbt", ["ordered_target_enc", "gbt_score"]),
    ("M5", "operators.scorecard.fit; operators.gbt.fit_best_prefix", ["scorecard_fit", "scorecard_score", "gbt_score"]),
    ("M6", "operators.scorecard.score; operators.gbt.score", ["scorecard_score", "gbt_score"]),
    ("M7", "operators.metrics.auc / confusion / report_from_confusion", ["auc", "auc_gap", "confusion", "class_report"]),
    ("M8", "operators.resample.vdm_table / oversample over operators.neighbours.knn (pivot bounds)", ["vdm_table", "smoten", "smote_nc"]),
    ("M9", "operators.runs.runs_table / gbt_runs_table", ["runs_log", "runs_gbt"]),
    ("M10", "operators.whatif.counterfactual", ["counterfactual", "scenario_tiers", "tier_stability"]),
    ("M11", "operators.whatif.perturb / sensitivity", ["perturb", "sensitivity"]),
    ("M12", "operators.scorecard.attributions; operators.treeshap.attributions", ["shap_linear", "shap_tree"]),
    ("M13", "operators.gbt.importance", ["gbt_importance"]),
    ("M14", "operators.audit.train_and_store / audit; store_pipeline / audit_pipeline (trees)", ["audit_report", "audit_trees"]),
    ("M15", "operators.metrics.truth_match", ["truth_match"]),
    ("T1", "streaming.submissions.aligned / score_requests / run_stream (stored survey scorecard)", ["stream_score", "stream_explained"]),
    ("T2", "streaming.submissions.write_batch / committed (commit log)", ["persist_three", "stream_quarantine"]),
]


def main() -> None:
    registry.load_all()
    lines = ["# Operator map (SURVEY §2 → code → registered query)", "",
             "Check: **V** = value-checked against a DuckDB twin, **R** = rows-only (invariant tests in "
             "`tests/`). Generated by `tools/operator_map.py`.", "",
             "| ID | Implementation (`scorelake.`…) | Query keys |", "|---|---|---|"]
    used = set()
    for sid, impl, keys in MAP:
        cells = []
        for k in keys:
            if k in registry.QUERIES:
                used.add(k)
                cells.append(f"`{k}` {'V' if k in registry.ORACLE else 'R'}")
            else:
                cells.append(k)
        lines.append(f"| {sid} | {impl} | {', '.join(cells)} |")
    extra = sorted(set(registry.QUERIES) - used)
    lines += ["", f"Registered queries: {len(registry.QUERIES)} ({len(registry.ORACLE)} with a DuckDB twin)."]
    if extra:
        lines.append("Not listed above: " + ", ".join(f"`{k}`" for k in extra))
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "OPERATORS.md"),
         "w").write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
