"""Questions, recommendations and reports over rule results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cues of intents, the first that fits.
INTENTS = [
    ("COMPARE", r"(?i)\b(compare|difference|differ|match)\w*"), ("DUPLICATES", r"(?i)\bduplicate\w*"), ("POLICY_QUESTION", r"(?i)\b(policy|allowed|limit|rule)\w*"),
    ("SUMMARY", r"(?i)\b(summary|summari[sz]e|overview)\b"),
]


def intent(question: Column) -> Column:
    out = F.when(question.isNull(), None)
    for name, cue in INTENTS:
        out = out.when(question.rlike(cue), name)
    return out.otherwise("INVESTIGATE")


def recommendation(results: DataFrame) -> DataFrame:
    """The baseline action of a document from its outcomes, in order of weight."""
    c = F.col
    per = results.groupBy("doc_id").agg(
        F.count_if(c("outcome") == "FAIL").alias("failing"), F.count_if(c("outcome").isin("WARN", "ERROR")).alias("attention"),
        F.bool_or((c("outcome") == "FAIL") & c("severity").isin("HIGH", "CRITICAL")).alias("severe"), F.bool_or((c("outcome") == "FAIL") & (c("code") == "INV_DUPLICATE")).alias("duplicate"))
    action = F.when(c("duplicate"), "REJECT").when(c("severe"), "HOLD").when(c("failing") > 0, "REVIEW").when(c("attention") > 0, "CHECK").otherwise("APPROVE")
    return per.withColumn("action", action)


def confidence(factors: DataFrame, key: str) -> DataFrame:
    """One less the worst effect of each factor: ``score, level``."""
    worst = factors.groupBy(key, "factor").agg(F.min("effect").alias("effect"))
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 + F.sum("effect"))), 2)
    return worst.groupBy(key).agg(score.alias("score")).withColumn("level", F.when(F.col("score") >= 0.8, "HIGH").when(F.col("score") >= 0.55, "MEDIUM").otherwise("LOW"))


def may_approve(makers: Column, user: str) -> Column:
    """Maker and checker differ."""
    return ~F.array_contains(makers, user)


def snapshot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row's canonical text and its hash."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
    return df.withColumn("body", body).withColumn("sha256", F.sha2(body, 256))
