"""The queries of the de-identification engine and their SQL."""

from __future__ import annotations

from . import queries as q
from .oracles import ORACLE_SQL

QUERIES = {
    f.__name__: f
    for f in (
        q.mask_stats_by_type, q.mapping_values, q.mask_totals, q.restore_roundtrip, q.restore_by_join, q.luhn_values, q.html_text, q.flatten_props,
        q.id_checksum, q.credit_checksum, q.structured_rules, q.structured_types, q.all_dates, q.person_placeholders, q.entity_table,
        q.role_conflicts, q.company_links, q.slash_accounts, q.preprocessed, q.scan_findings, q.scan_documents, q.review_residues,
        q.review_tiers, q.surviving_originals, q.eval_scores, q.eval_macro, q.column_kinds, q.cells_masked, q.cells_restored, q.table_companies, q.cell_offsets, q.resume_pending,
        q.fingerprint_changed, q.batch_report, q.reply_check, q.stage_merge, q.drift_restore, q.mapping_markdown, q.redaction_boxes, q.output_names, q.synthetic_recall,
        q.synthetic_valid, q.bio_labels, q.user_rule_pass, q.reply_final, q.audit_counts, q.shared_people, q.recognised, q.retyped_cells,
        q.discovered_names, q.transaction_names, q.discovered_masked, q.file_names, q.value_frequency, q.redaction_counts, q.mapping_counts, q.sealed_mappings, q.repaired,
        q.more_rules, q.one_value_two_rules, q.scan_first_five, q.surest_entities, q.covered_boxes, q.still_readable, q.template_gate, q.prompts, q.known_headers,
        q.review_text, q.batch_review, q.csv_lines, q.converted, q.long_spans,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
