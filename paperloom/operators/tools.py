"""The tools of an agent: named operators over visible documents, each a DataFrame in and out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import matching, retrieval, rules, search
from .access import valid_on

#: Whatever a tool may read, by name.
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Tool:
    """What a tool is called and for, the arguments that it needs, and whether it changes anything."""

    name: str
    purpose: str
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]
    writes: bool = False


def _of(df: DataFrame, document_id: int) -> DataFrame:
    return df.where(F.col("doc_id") == document_id)


def _search(t: Tables, query: str, limit: int = 20) -> DataFrame:
    asked = search.parse(query)
    docs = t["documents"]
    named = None
    if asked.vendor:
        named = t["vendors"].where(F.contains(F.lower("name"), F.lit(asked.vendor.lower()))).select("vendor_id")
    return search.structured(docs, asked, named).limit(limit)


def _policies(t: Tables, question: str, day: str, limit: int = 5) -> DataFrame:
    """Passages in force on a day that hold most of the question's weight."""
    words = t["passages"].withColumn("words", F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+", -1)))
    terms = sorted(set(question.lower().split()))
    scored = retrieval.term_coverage(valid_on(words, day), "doc_id", "words", terms).where("coverage > 0")
    return scored.orderBy(F.desc("coverage"), "doc_id").limit(limit).select("doc_id", "text", "coverage")


def _compare(t: Tables, document_id: int) -> DataFrame:
    left, right, header = (_of(t[x], document_id) for x in ("invoice_lines", "order_lines", "invoices"))
    return matching.compare_lines(left, right, matching.compare_headers(header, _of(t["orders"], document_id)))


def _rules(t: Tables, document_id: int) -> DataFrame:
    results = rules.line_rules(_of(t["compared"], document_id)).select("doc_id", "code", "outcome")
    return results.unionByName(rules.header_rules(_of(t["compared_headers"], document_id)).select("doc_id", "code", "outcome"))


def _review(t: Tables, document_id: int, reason: str) -> DataFrame:
    """The task to add; one that is open already stays."""
    open_ = _of(t["tasks"], document_id).where("state = 'OPEN'")
    row = _of(t["documents"], document_id).select("doc_id", F.lit("REQUESTED").alias("task_type"), F.lit("OPEN").alias("state"), F.lit(reason).alias("reason"))
    return row.join(open_.select("doc_id").distinct(), "doc_id", "left_anti")


def _report(t: Tables, document_id: int) -> DataFrame:
    counts = _rules(t, document_id).groupBy("doc_id").agg(F.count("*").alias("rules"), F.count_if(F.col("outcome") == "FAIL").alias("failed"))
    return _of(t["documents"], document_id).join(counts, "doc_id", "left").fillna(0, ["rules", "failed"])


TOOLS = {
    tool.name: tool
    for tool in [
        Tool("search_documents", "find documents by type, vendor, amounts, dates, payment terms or words", ("query",), _search),
        Tool("get_document", "metadata of one document", ("document_id",), lambda t, document_id: _of(t["documents"], document_id)),
        Tool("get_extracted_fields", "its values, with confidence", ("document_id",), lambda t, document_id: _of(t["fields"], document_id)),
        Tool("get_document_evidence", "where one of its values stands", ("document_id", "path"), lambda t, document_id, path: _of(t["fields"], document_id).where(F.col("path") == path)),
        Tool("search_knowledge_base", "policy passages in force on a day", ("question", "day"), _policies),
        Tool("compare_documents", "an invoice with its order, line by line", ("document_id",), _compare),
        Tool("run_business_rules", "the outcomes of all rules", ("document_id",), _rules),
        Tool("create_review_task", "ask a person to look", ("document_id", "reason"), _review, writes=True),
        Tool("generate_report", "a document with its outcomes counted", ("document_id",), _report, writes=True),
        Tool("get_workflow_status", "the steps of its workflows, newest first", ("document_id",), lambda t, document_id: _of(t["jobs"], document_id).orderBy(F.desc("created_at"))),
    ]
}


def call(name: str, tables: Tables, allowed: set[str] | None = None, **arguments) -> DataFrame:
    """Runs a tool over the tables that the caller may see; unknown names, forbidden tools and missing arguments are errors."""
    if name not in TOOLS:
        raise KeyError(f"no tool {name}")
    if allowed is not None and name not in allowed:
        raise PermissionError(name)
    missing = [a for a in TOOLS[name].needs if a not in arguments]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return TOOLS[name].run(tables, **arguments)
