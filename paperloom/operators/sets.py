"""Set operations: division, related rows, bags, changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subset(a: str | Column, b: str | Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def every_member(df: DataFrame, key: str, member: str, seen: DataFrame) -> DataFrame:
    """Keys all of whose members are in ``seen`` (relational division): one join, one aggregate."""
    marked = df.join(seen.select(F.col(member).alias("__m"), F.lit(True).alias("__seen")).distinct(), F.col(member) == F.col("__m"), "left")
    return marked.groupBy(key).agg(F.bool_and(F.coalesce("__seen", F.lit(False))).alias("__all")).where("__all").select(key)


def related(df: DataFrame, id: str, keys: list[list[str]]) -> DataFrame:
    """Pairs of rows that share any of several keys: a union of equi-joins, not an OR join.

    Pairs are the result here; to find only what is affected, join on one key at a time.
    """
    parts = []
    for columns in keys:
        left = df.select(F.col(id), *columns)
        right = df.select(F.col(id).alias("other_id"), *columns)
        parts.append(left.join(right, columns).where(F.col(id) != F.col("other_id")).select(id, "other_id"))
    return reduce(DataFrame.unionByName, parts).distinct()


def related_groups(df: DataFrame, id: str, keys: dict[str, list[str]]) -> DataFrame:
    """``id, kind, oldest, others``: of each key that a row shares, the smallest id of the group, and how many others it has.

    A group is its members and their number; pairs are never listed, so a frequent value costs
    a row a member.  Counts are aggregated before they meet the rows again.
    """
    parts = []
    for kind, columns in keys.items():
        groups = df.dropna(subset=columns).groupBy(*columns).agg(F.min(id).alias("oldest"), (F.count("*") - 1).alias("others")).where("others > 0")
        parts.append(df.join(groups, columns).select(id, F.lit(kind).alias("kind"), "oldest", "others"))
    return reduce(DataFrame.unionByName, parts)


def oldest_copy(df: DataFrame, digest: str, id: str, alias: str) -> DataFrame:
    """The smallest id of each digest; the minimum is aggregated first, so copies make no large window."""
    first = df.groupBy(F.col(digest).alias("__d")).agg(F.min(id).alias(alias))
    return df.join(first, F.col(digest).eqNullSafe(F.col("__d"))).drop("__d")


def bag_overlap(words: DataFrame, keys: list[str], word: str, left: Column) -> DataFrame:
    """Size of the multiset intersection of two sides of each key: ``shared``."""
    counts = words.groupBy(*keys, word).agg(F.count_if(left).alias("__a"), F.count_if(~left).alias("__b"))
    return counts.groupBy(*keys).agg(F.sum(F.least("__a", "__b")).alias("shared"))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in only one of two versions, and which: ``change`` ADDED or REMOVED."""
    a, b = old.select(*keys, F.lit(1).alias("__old")), new.select(*keys, F.lit(1).alias("__new"))
    both = a.join(b, keys, "full").where("__old IS NULL OR __new IS NULL")
    return both.select(*keys, F.when(F.col("__old").isNull(), "ADDED").otherwise("REMOVED").alias("change"))
