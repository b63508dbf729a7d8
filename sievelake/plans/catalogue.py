"""The library's queries by name, each with its DuckDB twin."""

from __future__ import annotations

from sievelake.plans import q_answers, q_copies, q_decide, q_evidence, q_fields, q_more, q_names, q_rank, q_report, q_rounds, q_shelves, q_store, q_text  # noqa: F401
from sievelake.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
