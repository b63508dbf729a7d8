"""Texts that stand in for names, answers and titles: rows of the star schema choose among written-out ones by their key."""

from __future__ import annotations

from pyspark.sql import functions as F


def chosen(key: str, values: list):
    """Column: values[key mod their number]."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def sql_text(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def chosen_sql(key: str, values: list) -> str:
    """The same in DuckDB."""
    return f"list_extract([{', '.join(map(sql_text, values))}], CAST({key} % {len(values)} AS INT) + 1)"
