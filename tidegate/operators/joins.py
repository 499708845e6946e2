"""Joins beyond what DataFrame.join says in a word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """On all columns of the same name; without one, the product."""
    shared = [c for c in left.columns if c.lower() in {r.lower() for r in right.columns}]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def using(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Equality of the columns; the output keeps both copies, the right one with the suffix _right."""
    renamed = right.select([F.col(c).alias(f"{c}_right") if c in columns else F.col(c) for c in right.columns])
    return left.join(renamed, [F.col(c) == F.col(f"{c}_right") for c in columns], how)


def null_safe(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """As using, but NULL equals NULL."""
    renamed = right.select([F.col(c).alias(f"{c}_right") if c in columns else F.col(c) for c in right.columns])
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"{c}_right")) for c in columns], how)


#: Keys are counted by hash, in so many groups; one with more than a HOT_KEYS-th of the rows is hot, so fewer than HOT_KEYS are.
GROUPS, HOT_KEYS = 65_536, 10_000


def salted(big: DataFrame, small: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread: their rows in the big side draw one of `salts` numbers, in the small side have all.

    For keys that adaptive execution cannot split, as before an aggregation by the same key. how: inner or left.
    The big side's keys are counted first; rows of other keys are neither dealt nor repeated. Keys of two types have
    no common hash, and then all are taken for hot. Always a join of two shuffles: by the size of the files behind it
    the small side may look as if it could be broadcast when its rows are far more than that.
    """
    if how not in ("inner", "left"):
        raise ValueError("only the big side can be kept whole")
    drawn = F.pmod(F.xxhash64(*[c for c, t in big.dtypes if not t.startswith("map")]), F.lit(salts))
    every = F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")
    if big.schema[key].dataType != small.schema[key].dataType:
        return big.withColumn("_salt", drawn).join(small.withColumn("_salt", F.explode(every)).hint("merge"), [key, "_salt"], how).drop("_salt")
    group = F.xxhash64(key).bitwiseAND(F.lit(GROUPS - 1)).alias("_group")
    counts = big.filter(F.col(key).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"))
    most = F.greatest(F.lit(100), F.col("_all") / HOT_KEYS)
    hot = F.broadcast(counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).filter(F.col("_n") > most).select("_group", F.lit(True).alias("_hot")))
    # rows without a key meet nothing, wherever they are
    a = big.withColumn("_group", group).join(hot, "_group", "left").withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), drawn).otherwise(F.lit(0)))
    b = small.withColumn("_group", group).join(hot, "_group", "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0).cast("bigint")))))
    return a.drop("_group", "_hot").join(b.drop("_group", "_hot").hint("merge"), [key, "_salt"], how).drop("_salt")
