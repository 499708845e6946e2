"""Vector metrics as folds over arrays of doubles."""

from __future__ import annotations


def _v(x: str) -> str:
    return f"cast(({x}) AS array<double>)"


def _fold(a: str, b: str, term: str) -> str:
    return f"aggregate(zip_with({_v(a)}, {_v(b)}, (x, y) -> {term}), 0D, (s, t) -> s + t)"


def inner_product(a: str, b: str) -> str:
    """0 if the lengths differ."""
    return f"(CASE WHEN size({a}) = size({b}) THEN {_fold(a, b, 'x * y')} WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN 0D END)"


def l2_distance(a: str, b: str) -> str:
    """Infinity if the lengths differ."""
    return f"(CASE WHEN size({a}) = size({b}) THEN sqrt({_fold(a, b, '(x - y) * (x - y)')}) WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN double('Infinity') END)"


def cosine_similarity(a: str, b: str) -> str:
    """0 if either is a zero vector, -1 if the lengths differ."""
    norms = f"(sqrt({_fold(a, a, 'x * y')}) * sqrt({_fold(b, b, 'x * y')}))"
    return f"(CASE WHEN size({a}) = size({b}) THEN coalesce(try_divide({_fold(a, b, 'x * y')}, {norms}), 0D) WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN -1D END)"


FUNCTIONS = {
    "COSINE_SIMILARITY": cosine_similarity,
    "L2_DISTANCE": l2_distance,
    "L2_DIST": l2_distance,
    "INNER_PRODUCT": inner_product,
    "DOT_PRODUCT": inner_product,
    "DOT": inner_product,
}
