"""The queries of this subpackage and their SQL."""

from . import bpe, chat_format, embedding_dedup, hard_negatives, lm_score, mil_quality, minhash_dedup, mixing, prefix_trie, quality_rules, sharding, substring_dedup, url_filter  # noqa: F401
from .common import QUERIES
from .sql import SQL


def queries() -> dict:
    return {e.name: e.run for e in QUERIES.entries}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
