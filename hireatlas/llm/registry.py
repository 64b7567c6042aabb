"""Queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from . import byte_pairs, decontamination, exact_dedup, fill_in_middle, language, language_model, line_dedup, mixing, near_dedup, privacy, quality, toxicity, whitening

_MODULES = (line_dedup, language_model, mixing, decontamination, quality, near_dedup, language, toxicity, exact_dedup, privacy, byte_pairs, whitening, fill_in_middle)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
