"""All queries of this package; importing it registers them."""

from terrascore.llm import (  # noqa: F401  (registers the queries)
    bpe,
    chats,
    clusters,
    fingerprints,
    languages,
    licences,
    mixing,
    neardup,
    neighbours,
    private,
    repair,
    secrets,
    sharding,
)
from terrascore.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
