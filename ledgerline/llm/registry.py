"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> (module, function, name of the module's SQL or None)
_REGISTERED = {
    "op1_url_filter": ("url_filter", "OP1_SQL"),
    "op2_ngram_jaccard_join": ("ngram_join", "OP2_SQL"),
    "op3_warc": ("warc", "OP3_SQL"),
    "op4_spotsigs": ("spotsigs", None),
    "op5_quality_classifier": ("quality", None),
    "op6_best_fit_packing": ("packing", None),
    "op7_sentencepiece": ("tokenizer", None),
    "op8_language_id": ("langid", None),
    "op9_embedding_near_dedup": ("lattice_dedup", "OP9_SQL"),
    "op10_html_extraction": ("html_extract", None),
    "op11_pii": ("pii", None),
    "op12_lexical_search": ("lexical_search", "OP12_SQL"),
    "op13_conversation_trie": ("prefix_trie", "OP13_SQL"),
}


def queries() -> dict:
    """name -> callable(spark, sf_dir)."""
    return {name: getattr(import_module(f".{module}", __package__), name) for name, (module, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL, where SQL can express the query."""
    return {name: getattr(import_module(f".{module}", __package__), sql) for name, (module, sql) in _REGISTERED.items() if sql}
