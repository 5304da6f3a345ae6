"""URL filters: rules indexed by their rarest literal token (native)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, with_columns

SCHEMA = "rule string, is_host boolean, pattern string, verdict string, literals array<string>"

#: The host and path rules of the contract.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Words that whole tokens of a URL must not be, where no host rule decides.
BLOCKED_WORDS = ["casino", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx"]


def host_rule(rule: str, verdict: str) -> tuple:
    """``host/path``: fits the host and its subdomains if the path starts so.

    A token of the path is literal only if a character of the rule ends it; the last one of
    ``/en`` would also fit ``/english``.
    """
    host, slash, path = rule.partition("/")
    path = slash + path
    tokens = re.findall("[0-9A-Za-z]+", host.lower()) + re.findall("[0-9A-Za-z]+(?=[^0-9A-Za-z])", path)
    return rule, True, rf"^([^/]*\.)?{_quoted(host.lower())}{_quoted(path)}", verdict, tokens


def pattern_rule(name: str, pattern: str, verdict: str, literals: list[str]) -> tuple:
    """A regular expression over host and path; every URL it fits holds all ``literals`` as whole tokens."""
    return name, False, pattern, verdict, list(literals)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/-_" else f"\\{c}" for c in text)


def rules_frame(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """The rules of a list as a DataFrame.  Sets too large for the driver are read from a table of this schema."""
    if not rules:
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ", 1) for x in SCHEMA.split(", "))])
    rows = [
        F.struct(
            F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("is_host"), F.lit(r[2]).alias("pattern"), F.lit(r[3]).alias("verdict"),
            F.array(*map(F.lit, r[4])).cast("array<string>").alias("literals"),
        ) for r in rules
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def default_rules(spark: SparkSession) -> DataFrame:
    words = [pattern_rule(w, f"(?<![0-9A-Za-z]){w}(?![0-9A-Za-z])", "block", [w]) for w in BLOCKED_WORDS]
    return rules_frame(spark, [host_rule(*r) for r in HOST_RULES] + words)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Judges every URL by the rules that share a rare token with it.

    Each rule is indexed by the one of its literal tokens that the fewest of these URLs
    hold.  The tokens of a URL fetch candidate rules by an equi-join, and only those run
    their regular expression, over host and path.  Distinct URLs are judged once, so a
    frequent URL is one row until the last join, whose skew AQE splits.  Rules without a
    literal token are candidates of every URL.  Catalyst broadcasts the index if its size
    allows.

    Among fitting host rules the longest wins (ties: the smaller rule, then "block" over
    others).  Without one, ``verdict`` is "block" if a fitting pattern rule says so, else
    "allow".  Null URLs and those without ``://`` have an empty host and path; they fit
    nothing but literal-free patterns.  Returns the columns of ``pages``, then ``host,
    path, rule`` (of the host rule, else null), ``verdict`` and ``pattern_rule`` (smallest
    fitting one, else null); columns of these names in ``pages`` give way, all others stay,
    whatever their names.  Repeated rows are judged alike.  An empty table gives an empty
    table, an empty set of rules allows everything.
    """
    judged, by_host, by_pattern = free_names(pages, "judged", "by_host", "by_pattern")
    column = F.col(f"`{url}`")
    host, path = _parts(column)
    seen = pages.select(column.alias("url")).where("url IS NOT NULL").distinct()
    seen = seen.select("url", F.concat(*_parts(F.col("url"))).alias("target"))
    tokens = F.array_append(F.array_distinct(F.filter(F.split("target", "[^0-9A-Za-z]+", -1), lambda t: t != "")), F.lit(""))
    asked = seen.select("url", "target", F.explode(tokens).alias("token"))

    index = rule_index(rules, asked)
    fits = asked.join(index, "token").where(F.expr("target RLIKE pattern"))
    best = fits.groupBy("url").agg(
        F.min(F.when(F.col("is_host"), F.struct((-F.length("rule")).alias("n"), "rule", (F.col("verdict") != "block").alias("ok"), "verdict"))).alias(by_host),
        F.min(F.when(~F.col("is_host"), F.struct((F.col("verdict") != "block").alias("ok"), "rule", "verdict"))).alias(by_pattern),
    )
    joined = pages.join(best.withColumnRenamed("url", judged), column == F.col(judged), "left")
    return with_columns(joined, {
        "host": host, "path": path, "rule": F.col(f"{by_host}.rule"),
        "verdict": F.coalesce(f"{by_host}.verdict", f"{by_pattern}.verdict", F.lit("allow")), "pattern_rule": F.col(f"{by_pattern}.rule"),
    }).drop(judged, by_host, by_pattern)


def rule_index(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """Each rule with ``token``: of its literals the one that the fewest ``asked`` (a row a URL and distinct token) hold.

    A literal that no URL holds is the rarest of all; ties go to the smaller word.  A rule
    without literals has the empty token, which every URL has.
    """
    numbered = rules.withColumn("literals", F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.lit(""))))
    literals = numbered.select("rule", "is_host", "pattern", "verdict", F.explode("literals").alias("token"))
    held = asked.select("token").join(literals.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    return (
        literals.join(held, "token", "left")
        .groupBy("rule", "is_host", "pattern", "verdict")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )


def _parts(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
