"""All queries of this package; importing the operators registers them."""

from vistalake.llm import collocations, decontaminate, hard_negatives, lm, near_vectors, ngram_join, packing, pii, quality, secrets, suffix_dedup, token_counts, topk  # noqa: F401
from vistalake.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
