"""Column lists of the canonical tables."""

from __future__ import annotations

FACT_COLUMNS = [
    "return_id", "tax_year", "sub_no", "entity_code", "entity_name", "form", "instance",
    "document_id", "basket", "path", "ordinal", "value", "is_blank",
]
FINDING_COLUMNS = [
    "return_id", "check_id", "severity", "category", "entity_code", "entity_name", "sub_key",
    "description", "expected", "actual", "delta", "context",
]
CHANGE_COLUMNS = ["return_id", "entity_name", "field", "old_value", "new_value", "numeric_diff", "material"]
ITEM_COLUMNS = [
    "return_id", "report", "entity_name", "entity_code", "description", "line",
    "py_value", "cy_value", "difference", "passes",
]
RECON_COLUMNS = ["return_id", "entity_code", "schedule", "field_name", "line", "wb_value", "xml_value", "delta", "status"]

#: partitioning of a stored facts table; year and form prune most scans
FACT_PARTITIONS = ["tax_year", "form"]
