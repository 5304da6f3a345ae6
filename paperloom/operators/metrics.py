"""Dashboard aggregates, and evaluation metrics."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored


def ratio(a: Column, b: Column) -> Column:
    """Null where undefined."""
    return F.when(b != 0, a / b)


def zero_filled(counts: DataFrame, labels: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Every label with its counts, or 0."""
    return labels.join(counts, on, "left").fillna(0, columns)


def daily_series(df: DataFrame, day: Column, *aggregates: Column) -> DataFrame:
    """A row for each day from the first to the last, those without rows too."""
    daily = df.groupBy(day.alias("day")).agg(*aggregates)
    span = daily.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(daily, "day", "left")


def nearest_ranks(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 256) -> DataFrame:
    """``*keys`` and, for each alias of ``shares``, the value at rank ``round(share * (n - 1))``, halves to even.

    No group is sorted: a group's values are counted in ``bins`` equal bins between its bounds,
    and the bin that holds the rank gives the next bounds, until these are one value.  Counts
    are partial sums, so a group of very many rows is at most ``bins`` rows a task before a
    shuffle; bounds are values that occur, so each round at least parts the least from the
    greatest.  Nulls do not count; a group without values is absent.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    names = [f"__k{i}" for i in range(len(keys))]
    wanted = F.explode(F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(float(s)).alias("share")) for a, s in shares.items()]))
    bounds = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    todo = bounds.select(*names, "low", "high", "n", wanted.alias("s"))
    todo = stored(todo.select(*names, "low", "high", F.col("s.alias").alias("alias"), F.bround(F.col("s.share") * (F.col("n") - 1)).cast("long").alias("at")), "ranks")
    done = []
    while True:
        done.append(todo.where("low = high").select(*names, "alias", F.col("low").alias("value")))
        todo = todo.where("low < high")
        if todo.isEmpty():
            break
        inside = rows.join(todo, _same(keys, names) & F.col("__v").between(F.col("low"), F.col("high")))
        low, high = F.col("low").cast("double"), F.col("high").cast("double")
        place = F.least(F.lit(bins - 1), F.floor((F.col("__v").cast("double") - low) / (high - low) * bins)).cast("int")
        place = F.when(F.col("__v") == F.col("high"), bins).otherwise(F.coalesce(place, F.lit(0)))  # the greatest is a bin of its own
        counts = inside.groupBy(*names, "alias", "at", place.alias("bin")).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*names, "alias").orderBy("bin"))
        held = counts.withColumn("upto", upto).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at")))
        todo = stored(held.select(*names, "low", "high", "alias", (F.col("at") - F.col("upto") + F.col("n")).alias("at")), "ranks")
    found = reduce(DataFrame.unionByName, done)
    columns = [F.max(F.when(F.col("alias") == a, F.col("value"))).alias(a) for a in shares]
    return found.groupBy(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)]).agg(*columns)


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(m).eqNullSafe(F.col(n)) for m, n in zip(a, b, strict=True)], F.lit(True))


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float, alias: str) -> DataFrame:
    return nearest_ranks(df, keys, value, {alias: share})


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def classification_report(df: DataFrame, truth: str, label: str) -> DataFrame:
    """Per class: support, tp, fp, fn, precision, recall, f1."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.when(F.col("t") == F.col("l"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("l").alias("class"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted")),
    )).alias("x")).select("x.*")
    sums = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"))
    scored = precision_recall(F.col("tp").cast("double"), (F.col("predicted") - F.col("tp")).cast("double"), (F.col("support") - F.col("tp")).cast("double"))
    return sums.select("class", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), *[c.alias(n) for n, c in scored.items()])


def calibration_error(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over right-closed bins: ``ece`` (one row)."""
    at = F.greatest(F.lit(1), F.ceil(F.col(confidence) * bins))
    binned = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(confidence).cast("double")).alias("conf"), F.avg(correct.cast("double")).alias("acc"))
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """Left-closed bins, the last one closed on both sides: ``bin, n, confidence, accuracy``."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins))
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(confidence).cast("double")).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def clopper_pearson(errors: int, n: int, level: float = 0.95) -> float:
    """One-sided upper bound of an error rate: where the chance of so few errors is ``1 - level``."""
    if n == 0 or errors >= n:
        return 1.0

    def at_most(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + (i * math.log(p) if i else 0) + (n - i) * math.log1p(-p) for i in range(errors + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if at_most(middle) > 1 - level:
            low = middle
        else:
            high = middle
    return high


@F.pandas_udf(T.DoubleType())
def error_bound(errors: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([clopper_pearson(int(e), int(m)) for e, m in zip(errors, n, strict=True)])


def threshold_sweep(df: DataFrame, confidence: str, wrong: Column, steps: int = 20) -> DataFrame:
    """For each threshold of a grid: rows at or above it, errors among them, and the bound of their rate.

    Rows are summed by the grid cell that they reach, so the grid multiplies nothing.
    """
    spark = df.sparkSession
    cell = F.least(F.lit(steps), F.floor(F.col(confidence) * steps)).cast("int")
    cells = df.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors"))
    grid = spark.range(steps + 1).select(F.col("id").cast("int").alias("cell"))
    down = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(cells, "cell", "left").fillna(0, ["n", "errors"])
    return full.select((F.col("cell") / steps).alias("threshold"), F.sum("n").over(down).alias("n"), F.sum("errors").over(down).alias("errors"))


def choose_threshold(sweep: DataFrame, floor: float) -> DataFrame:
    """The lowest threshold from ``floor`` on with no error at or above it: ``threshold`` (one row)."""
    return sweep.where((F.col("threshold") >= floor) & (F.col("errors") == 0)).agg(F.min("threshold").alias("threshold"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """Per query: hit@k, precision@k, reciprocal rank, nDCG@k of ranked items against the relevant ones."""
    total = relevant.groupBy(query).agg(F.countDistinct(item).alias("__relevant"))
    hit = ranked.join(relevant.select(query, item, F.lit(1).alias("__hit")).distinct(), [query, item], "left").withColumn("__hit", F.coalesce("__hit", F.lit(0)))
    gain = F.when(F.col(rank) <= k, F.col("__hit") / F.log2(F.col(rank) + 1.0)).otherwise(0.0)
    per = hit.groupBy(query).agg(
        F.max(F.when(F.col(rank) <= k, F.col("__hit")).otherwise(0)).alias("hit"), (F.sum(F.when(F.col(rank) <= k, F.col("__hit")).otherwise(0)) / k).alias("precision"),
        F.coalesce(F.max(F.when(F.col("__hit") == 1, 1.0 / F.col(rank))), F.lit(0.0)).alias("rr"), F.sum(gain).alias("__dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("__relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return total.join(per, query).withColumn("ndcg", F.col("__dcg") / ideal).drop("__dcg", "__relevant")


def gates(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """Whether each metric is within its bounds; missing and NaN fail."""
    joined = bounds.join(metrics, "metric", "left")
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("minimum").isNull() | (F.col("value") >= F.col("minimum"))) & (F.col("maximum").isNull() | (F.col("value") <= F.col("maximum")))
    return joined.withColumn("passed", ok)


def metric_at(report: Column, path: str) -> Column:
    """``struct(value, problem)`` of a number at a path of a JSON report: null values are missing, other kinds and NaN no numbers."""
    node = F.try_variant_get(F.try_parse_json(report), path, "variant")
    kind = F.schema_of_variant(node)
    value = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(F.try_parse_json(report), path, "double"))
    value = F.when(~F.isnan(value), value)
    problem = F.when(kind.isNull() | (kind == "VOID"), "missing").when(value.isNull(), "not a number")
    return F.struct(value.alias("value"), problem.alias("problem"))
