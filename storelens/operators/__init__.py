"""Reusable relational building blocks, each a composition of DataFrame primitives."""

from .joins import anti
from .topk import top_k, top_k_ranked, rank_at_most, top_n_per_group
from .shares import pct, rnd, share_of_total
from .reviews import per_app_reviews

__all__ = [
    "anti", "top_k", "top_k_ranked", "rank_at_most",
    "top_n_per_group", "pct", "rnd", "share_of_total", "per_app_reviews",
]
