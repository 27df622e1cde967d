"""Registry of the queries over the star schema and their DuckDB counterparts."""

from __future__ import annotations

from struklake.plans import oracles, queries

_NAMES = (
    "fixture_lines", "fixture_tokens",
    "receipt_totals", "receipt_totals_full", "line_amounts", "class_counts",
    "fix_text", "fix_words", "fix_numbers",
    "clean_store", "clean_address", "clean_item", "clean_number", "clean_date", "clean_conversations",
    "receipt_store", "receipt_address", "receipt_date", "documents_dates",
    "item_roles", "receipt_items", "layout_rows", "layout_lines",
    "receipt_result", "no_text_receipts", "scan_admission", "audit_lines",
    "line_features", "char_codes", "position_features", "line_labels", "line_labels_hook", "expense_categories",
    "cer", "label_confusion", "label_recall", "detection_summary", "best_epoch", "history_rows",
    "stream_totals", "stream_direct_totals", "stream_results", "held_out_recall", "held_out_reliability",
    "scanned_tokens", "result_records", "audit_classes", "default_labels", "label_map", "class_names", "metric_log",
    "receipt_split", "top_classes",
    "corrupt_scans", "bare_lines_result", "dictionary_conversations", "joined_class_names",
    "phrase_repairs", "phrase_dates", "phrase_amounts", "phrase_features", "phrase_roles",
)

QUERIES = {name: getattr(queries, name) for name in _NAMES}
ORACLES = {name: getattr(oracles, name.upper()) for name in _NAMES if hasattr(oracles, name.upper())}
