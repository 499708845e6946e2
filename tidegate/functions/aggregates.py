"""Aggregates of the dialect as Spark SQL: arguments, an optional FILTER condition, an optional order and separator."""

from __future__ import annotations


def _number(x: str) -> str:
    """Values that are no numbers do not count."""
    return f"try_cast(({x}) AS double)"


def _simple(form: str, number: bool = False):
    def template(args: list[str], distinct: bool, **_) -> str:
        x = _number(args[0]) if number else args[0]
        return form.format(("DISTINCT " if distinct else "") + x)

    return template


def group_concat(args: list[str], distinct: bool, order: str | None = None, separator: str = "','") -> str:
    """NULLs are skipped; nothing but NULLs gives NULL. Without an order, that of the values."""
    x = f"cast(({args[0]}) AS string)"
    return f"listagg({'DISTINCT ' if distinct else ''}{x}, {separator}) WITHIN GROUP (ORDER BY {x if distinct or not order else order})"


def json_arrayagg(args: list[str], distinct: bool, where: str = "", **_) -> str:
    """NULLs stay. The order is that in which rows arrive: after a shuffle, any."""
    return f"to_json(transform(collect_list(struct({args[0]} AS x)){where}, r -> r.x))"


def json_objectagg(args: list[str], distinct: bool, where: str = "", **_) -> str:
    """NULL keys are skipped; of equal ones the last counts, in the order in which rows arrive; keys are shown sorted."""
    entries = f"map_entries(map_from_entries(filter(collect_list(struct(cast(({args[0]}) AS string) AS k, {args[1]} AS v)){where}, e -> e.k IS NOT NULL)))"
    return f"to_json(map_from_entries(array_sort({entries}, (a, b) -> CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END)), map('ignoreNullFields', 'false'))"


#: STDDEV and VARIANCE are those of the population.
AGGREGATES = {
    "COUNT": lambda args, distinct, **_: f"count({'DISTINCT ' if distinct else ''}{', '.join(args)})",
    "SUM": _simple("sum({0})", True),
    "AVG": _simple("avg({0})", True),
    "MIN": _simple("min({0})"),
    "MAX": _simple("max({0})"),
    "GROUP_CONCAT": group_concat,
    "JSON_ARRAYAGG": json_arrayagg,
    "JSON_OBJECTAGG": json_objectagg,
    "STDDEV": _simple("stddev_pop({0})", True),
    "STD": _simple("stddev_pop({0})", True),
    "STDDEV_POP": _simple("stddev_pop({0})", True),
    "STDDEV_SAMP": _simple("stddev_samp({0})", True),
    "VARIANCE": _simple("var_pop({0})", True),
    "VAR_POP": _simple("var_pop({0})", True),
    "VAR_SAMP": _simple("var_samp({0})", True),
    # beyond the dialect
    "APPROX_COUNT_DISTINCT": _simple("approx_count_distinct({0})"),
    "BIT_OR": _simple("bit_or({0})"),
    "BIT_AND": _simple("bit_and({0})"),
}
WINDOW_ONLY = {"ROW_NUMBER", "RANK", "DENSE_RANK", "PERCENT_RANK", "CUME_DIST", "NTILE", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE"}
