"""All registered queries and their checks."""

from __future__ import annotations

from crosstie.plans import q_book_audit, q_history, q_ownership, q_recon, q_reports, q_rules, q_scalar, q_sources, q_validators  # noqa: F401  (register on import)
from crosstie.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
