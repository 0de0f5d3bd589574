"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Modules that each have QUERY = (name, function) and, if SQL can express it, ORACLE.
MODULES = ("line_dedup", "quality_model", "lm_score", "sentencepiece_trie", "quality_rules", "toxicity", "simhash", "decontaminate", "secrets", "warc", "sharding", "spelling", "ranked")


def _modules():
    return [importlib.import_module(f"kinelake.llm.{name}") for name in MODULES]


def queries():
    return dict(m.QUERY for m in _modules())


def oracle_sql():
    return {m.QUERY[0]: m.ORACLE for m in _modules() if getattr(m, "ORACLE", None)}
