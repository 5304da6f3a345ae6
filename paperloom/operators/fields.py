"""Fields of printed documents: labels and values, columns, rows, lists, currencies and document scores."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import partial_ratio
from ..functions.values import currencies, days, find_dates, find_numbers, label, percent, squash
from .extraction import review_level

#: What sums up a table instead of being a row of it.
SUMMARY = r"(?i)^\s*(sub-?\s?total|(grand )?total|sum|vat|tax|balance|amount due|carried forward)\b"


def labelled_values(lines: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """``doc_id, field, value, place``: what follows a label on its line, else stands below it.

    ``lines`` has ``doc_id, line, text``; ``labels`` names the synonyms of each field.  A
    line below that is itself a label is no value.  A value on the label's line wins over one
    below, then the first.  Null texts hold nothing; a field without value has no row.
    """
    patterns = {f: rf"(?i)^\s*(?:{'|'.join(map(re.escape, sorted(s, key=len, reverse=True)))})\b\s*[:#.]?\s*(.*)$" for f, s in labels.items()}
    is_label = lambda c: F.coalesce(c.rlike("|".join(patterns.values())), F.lit(False))
    below = F.lead("text").over(Window.partitionBy("doc_id").orderBy("line"))
    hit = lambda f, p: F.when(F.col("text").rlike(p), F.struct(F.lit(f).alias("field"), F.trim(F.regexp_extract("text", p, 1)).alias("rest")))
    found = lines.withColumn("below", below).select("doc_id", "line", "below", F.explode(F.array_compact(F.array(*[hit(*x) for x in patterns.items()]))).alias("x"))
    same = F.col("x.rest") != ""
    value = F.when(same, F.col("x.rest")).when(~is_label(F.col("below")), F.nullif(F.trim("below"), F.lit("")))
    found = found.select("doc_id", "line", "x.field", value.alias("value"), F.when(same, "SAME_LINE").otherwise("BELOW").alias("place")).where("value IS NOT NULL")
    best = F.min_by(F.struct("value", "place"), F.struct(F.col("place") == "BELOW", "line"))
    return found.groupBy("doc_id", "field").agg(best.alias("x")).select("doc_id", "field", "x.value", "x.place")


def map_columns(headers: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """``doc_id, field, position``: table columns by their header, exact synonyms before such at its start or end.

    ``headers`` has ``doc_id`` and the array ``headers``.  A column has one field and a field
    one column: the better kind of match wins, then the first column, then the order of
    ``synonyms``.
    """
    cells = headers.select("doc_id", F.posexplode("headers").alias("position", "header")).withColumn("header", label(F.col("header")))
    header = F.col("header")

    def kind(words: list[str]) -> Column:
        part = [header.startswith(F.lit(w + " ")) | header.endswith(F.lit(" " + w)) for w in words]
        either = part[0]
        for p in part[1:]:
            either = either | p
        return F.when(header.isin(words), 0).when(either, 1)

    options = [F.struct(kind(w).alias("kind"), F.lit(nr).alias("nr"), F.lit(f).alias("field")) for nr, (f, w) in enumerate(synonyms.items())]
    best = F.array_min(F.filter(F.array(*options), lambda o: o["kind"].isNotNull()))
    chosen = cells.select("doc_id", "position", best.alias("x")).where("x IS NOT NULL")
    return chosen.groupBy("doc_id", "x.field").agg(F.min(F.struct("x.kind", "position")).alias("at")).select("doc_id", "field", "at.position")


def table_rows(rows: DataFrame) -> DataFrame:
    """Plausible item rows, with code, description, quantity and unit apart.

    ``rows`` has ``doc_id, row, item, amount`` as text.  Summary rows and rows without any
    text or without a digit in the amount go.
    """
    item, amount = F.trim("item"), F.trim("amount")
    code = F.regexp_extract(item, r"^([A-Z]{2,}[ -]?[0-9]+)\s+(?:[-–]\s*)?(\S.*)$", 1)
    kept = rows.where(~F.coalesce(item, F.lit("")).rlike(SUMMARY) & (F.coalesce(item, F.lit("")) != "") & amount.rlike("[0-9]"))
    return kept.select(
        "doc_id", "row", F.nullif(code, F.lit("")).alias("code"), F.regexp_replace(item, r"^[A-Z]{2,}[ -]?[0-9]+\s+(?:[-–]\s*)?(?=\S)", "").alias("description"),
        F.regexp_extract(amount, r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("decimal(18,4)").alias("quantity"), F.nullif(F.regexp_extract(amount, r"([A-Za-z]+)\.?$", 1), F.lit("")).alias("unit"),
    )


def section_items(lines: DataFrame, headings: dict[str, str]) -> DataFrame:
    """``doc_id, section, item``: bulleted or numbered lines, each under the last heading before it.

    ``headings`` maps a pattern of headings to its section; any other line of no list ends the section.
    """
    text = F.trim("text")
    item = F.regexp_extract(text, r"^(?:[-*•]|[0-9]{1,2}[.)])\s+(\S.*)$", 1)
    section = F.coalesce(*[F.when(text.rlike(p), F.lit(s)) for p, s in headings.items()])
    mark = F.when((item == "") & (text != ""), F.coalesce(section, F.lit("")))
    current = F.last(mark, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("doc_id", "line", item.alias("item"), current.alias("section")).where("item <> '' AND section <> ''")


def document_currency(docs: DataFrame, stated: str, amounts: str) -> Column:
    """The stated currency, else the only one that the printed amounts name."""
    codes = F.array_distinct(F.flatten(F.transform(F.col(amounts), currencies)))
    return F.coalesce(F.col(stated), F.when(F.size(codes) == 1, F.get(codes, F.lit(0))))


def score_documents(fields: DataFrame, failed: Column, high: float = 0.85, medium: float = 0.6) -> DataFrame:
    """Confidence, status, review level and reasons of each document from its fields.

    ``fields`` has ``doc_id, name, required, in_table, confidence`` (null: not found) and
    what ``failed``, a check of the document that did not hold, needs.  The weakest
    required field and the weakest table cell bound the whole.
    """
    conf, found = F.col("confidence"), F.col("confidence").isNotNull()
    scalar = ~F.col("in_table")
    out = fields.groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(scalar & F.col("required"), F.coalesce(conf, F.lit(0.0)))), F.lit(1.0)).alias("required_confidence"),
        F.min(F.when(F.col("in_table") & found, conf)).alias("line_confidence"),
        F.sort_array(F.collect_set(F.when(scalar & F.col("required") & ~found, F.col("name")))).alias("missing"),
        F.bool_or(found).alias("any"), F.coalesce(F.bool_or(failed), F.lit(False)).alias("failed"),
    )
    overall = F.least("required_confidence", F.coalesce("line_confidence", F.lit(1.0)))
    some = F.size("missing") > 0
    out = out.withColumns({"confidence": overall, "status": F.when(~F.col("any"), "FAILED").when(some, "PARTIAL").otherwise("SUCCEEDED")})
    out = out.withColumn("level", review_level(F.col("confidence"), F.col("failed"), high, medium))
    reasons = F.array_compact(F.array(
        F.when(~F.col("any"), "EXTRACTION_FAILED").when(some, "MISSING_REQUIRED_FIELDS"), F.when(F.col("failed"), "EXTRACTION_INCONSISTENT"),
        F.when(F.col("any") & ~some & ~F.col("failed") & (F.col("level") != "AUTO"), "EXTRACTION_UNCERTAIN")))
    return out.select("doc_id", "required_confidence", "line_confidence", "confidence", "missing", "status", "level", reasons.alias("reasons"))


# ------------------------------------------------------------------ value against its quote


def _holds(value: str | None, source: str | None, kind: str) -> bool:
    if kind in ("MONEY", "QUANTITY", "INTEGER"):
        wanted = find_numbers(value or "")
        return bool(wanted) and any(abs(n) == abs(wanted[0][0]) for n, _, _ in find_numbers(source or ""))
    if kind == "DATE":
        wanted = find_dates(value or "")
        return bool(wanted) and len(wanted[0]) == 1 and [*wanted[0]] in find_dates(source or "")
    return partial_ratio(value or "", source or "") >= 90


@F.pandas_udf(T.BooleanType())
def _readable(value: pd.Series, source: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([_holds(*row) for row in zip(value, source, kind, strict=True)])


def value_in_source(kind: Column, value: Column, source: Column) -> Column:
    """Whether a value can be read from the text that is quoted for it.

    Its letters and digits occur there, or, by type, its number, date, rate or period does;
    other text may differ a little.  An empty quote holds nothing; a yes or no is read from
    the quote itself.
    """
    v, s = squash(value), squash(source)
    same = F.coalesce((v != "") & F.contains(s, v), F.lit(False))
    by_kind = (
        F.when(kind == "BOOLEAN", True).when(kind == "PERCENT", percent(value) == percent(source)).when(kind == "DAYS", days(value) == days(source))
        .when(kind == "CURRENCY", F.arrays_overlap(currencies(value), currencies(source)))
        .otherwise(_readable(F.when(kind.isin("MONEY", "QUANTITY", "INTEGER", "DATE"), value).otherwise(v), F.when(kind.isin("MONEY", "QUANTITY", "INTEGER", "DATE"), source).otherwise(s), kind))
    )
    return (F.trim(F.coalesce(source, F.lit(""))) != "") & (same | F.coalesce(by_kind, F.lit(False)))
