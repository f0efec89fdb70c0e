"""Queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from folioframe.llm import p1_markup, p2_encoding, p3_truncation, p4_consensus, p5_lookalike, p6_scan, p7_leak, p8_mix, p9_quality

MODULES = (p1_markup, p2_encoding, p3_truncation, p4_consensus, p5_lookalike, p6_scan, p7_leak, p8_mix, p9_quality)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
