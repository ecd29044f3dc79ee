"""Name search, entity matching and text analytics on Spark DataFrames.

The names below are looked up when first used, so importing the package costs nothing and needs no session.
"""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

_WHERE = {
    "clean_names": "operators.clean", "clean_names_loose": "operators.clean", "augment_names": "operators.augment", "merge_supp": "operators.augment",
    "expand": "operators.patterns", "preprocess": "operators.patterns", "preprocess_names": "operators.patterns", "mentions": "operators.search",
    "search_names": "operators.search", "search_names_optimized": "operators.search", "create_engine": "operators.search", "BaseSearchEngine": "operators.search", "wide": "operators.search",
    "link": "operators.linking", "link_all": "operators.linking", "process_text": "operators.linking", "entities": "operators.linking", "similar": "operators.linking",
    "parse_names": "operators.parsers", "parse_frame": "operators.parsers", "compare_parsers": "operators.parsers",
    "read_table": "sources.files", "write_table": "sources.files", "merge_results": "sources.files", "split_text_corpus": "sources.files",
    "Config": "plans.config", "get_config": "plans.config", "save_config": "plans.config", "create_sample_config": "plans.config", "setup_logging": "plans.config", "get_logger": "plans.config",
    "validate": "plans.validate", "search_stream": "streaming.search", "clean_stream": "streaming.search",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(name)
