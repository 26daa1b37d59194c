"""The subpackage's queries and their SQL."""

from importlib import import_module

MODULES = ["bpe", "quality_lm", "quality_rules", "html_text", "sharding", "near_dedup", "decontamination", "language_id", "line_dedup", "toxicity", "ngram_join", "vector_codes", "resampling"]


def collected() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f".{name}", __package__)
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
