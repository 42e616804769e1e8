"""Queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, jaccard_join, language, line_dedup, neighbours, packing, quality, secrets, sharding, substring_dedup

MODULES = {
    "op1_line_dedup": line_dedup,
    "op2_decontaminate": decontaminate,
    "op3_neighbours": neighbours,
    "op4_jaccard_join": jaccard_join,
    "op5_language": language,
    "op6_packing": packing,
    "op7_quality": quality,
    "op8_sharding": sharding,
    "op9_secrets": secrets,
    "op10_substring_dedup": substring_dedup,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in MODULES.items() if hasattr(module, "ORACLE")}
