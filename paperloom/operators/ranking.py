"""Top rows, pages, versions in time, runs and budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Review priorities, first come first.
PRIORITIES = ["URGENT", "HIGH", "NORMAL", "LOW"]
LAST_DAY = "9999-12-31"


def first_by(df: DataFrame, key: str, order: list[str], value: str, alias: str) -> DataFrame:
    """The value at the first position of each key: one aggregation, no correlated lookup."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(alias))


def concat_in_order(df: DataFrame, key: str, order: list[str], value: str, separator: str, alias: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["__value"]), separator).alias(alias))


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """A page with the count of all rows, which is one row and so safe to broadcast."""
    return df.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def review_order(tasks: DataFrame, limit: int) -> DataFrame:
    """Open first, then priority, due date (none last), newest; ``place`` numbers the page."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    order = [F.desc(F.col("state") == "OPEN"), rank, F.asc_nulls_last("due_at"), F.desc("created_at"), F.asc("task_id")]
    top = tasks.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def keyset_page(df: DataFrame, id: str, before: int, size: int) -> DataFrame:
    return df.where(F.col(id) < before).orderBy(F.desc(id)).limit(size + 1)


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """Catalyst limits each group before the shuffle, so a large group is no large window."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key by ``order``: a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def validity_windows(versions: DataFrame, key: str, start: str, end: str, id: str) -> DataFrame:
    """``valid_from, valid_to``: from the start to the day before the next start, or the own end if earlier."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start, id))
    last = F.lit(LAST_DAY).cast("date")
    to = F.least(F.coalesce(end, last), F.coalesce(F.date_sub(following, 1), last))
    return versions.withColumn("valid_from", F.col(start)).withColumn("valid_to", to)


def as_of_join(asked: DataFrame, day: str, windows: DataFrame, bucket_days: int = 365) -> DataFrame:
    """Versions valid on a day.

    The range condition becomes an equi-join on buckets of days, so the join is a hash join
    of any size: a window is repeated for each bucket that it covers up to the last day asked.
    """
    number = lambda c: F.floor(F.unix_date(c) / bucket_days)
    span = F.broadcast(asked.agg(F.min(number(F.col(day))).alias("__low"), F.max(number(F.col(day))).alias("__high")))  # one row
    low, high = F.greatest(number(F.col("valid_from")), F.col("__low")), F.least(number(F.col("valid_to")), F.col("__high"))
    spread = windows.crossJoin(span).where(low <= high).withColumn("__bucket", F.explode(F.sequence(low, high))).drop("__low", "__high")
    return asked.withColumn("__bucket", number(F.col(day))).join(spread, "__bucket").where(F.col(day).between(F.col("valid_from"), F.col("valid_to"))).drop("__bucket")


def islands(df: DataFrame, keys: list[str], number: str) -> GroupedData:
    """Groups of consecutive numbers within the keys."""
    run = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return df.withColumn("island", run).groupBy(*keys, "island")


def within_budget(df: DataFrame, keys: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """The longest prefix of each group within the budget, and always its first row."""
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = F.coalesce(F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return df.withColumn("__upto", upto).withColumn("__nr", F.row_number().over(window)).where((F.col("__upto") <= budget) | (F.col("__nr") == 1)).drop("__upto", "__nr")


def places(df: DataFrame, key: str, order: list[str], alias: str) -> DataFrame:
    """The place of each row among those of its ``key``, in an order that ends in a unique column.

    The rows are sorted by range over all tasks, so a key that holds much of the table is many
    partitions; each adds the rows of the key in the partitions before it, a count a key
    and partition.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    path = f"{shared_dir(df.sparkSession)}/places-{uuid.uuid4().hex}"
    df.repartitionByRange(parts, key, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    sorted_ = df.sparkSession.read.parquet(path)
    counts = sorted_.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(key).orderBy("__part")) - F.col("__n")).select(F.col(key).alias("__key"), F.col("__part").alias("__of"), "__before")
    inside = F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order))
    joined = sorted_.withColumn("__inside", inside).join(before, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")))
    return joined.withColumn(alias, F.col("__before") + F.col("__inside")).select(*df.columns, alias)
