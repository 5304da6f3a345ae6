"""Parquet tables, and the business-document views over them.

A view is one SQL text over named tables, in the common subset of Spark and DuckDB, so the
query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # Purchase orders: a header an order, a line an order and part.
    "po_header": """
        SELECT o_orderkey AS doc_id, concat('PO-', CAST(o_orderkey AS STRING)) AS number, o_custkey AS vendor_id,
            CASE WHEN o_orderkey % 29 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CAST(o_orderdate AS DATE) AS doc_date,
            CAST(o_totalprice AS DECIMAL(18,4)) AS total, 30 AS terms, o_orderpriority AS priority, o_orderstatus AS status
        FROM {orders}""",
    "po_lines": """
        SELECT l_orderkey AS doc_id, concat('SKU ', CAST(l_partkey AS STRING)) AS sku, p_name AS description,
            sum(CAST(l_quantity AS DECIMAL(18,4))) AS quantity, max(CAST(p_retailprice AS DECIMAL(18,4))) AS unit_price,
            CAST(0.98 AS DECIMAL(5,4)) AS confidence
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey, p_name""",
    # Invoices and delivery notes: the order's lines with planted differences.
    "inv_header": """
        SELECT doc_id, concat('INV-', CAST(CASE WHEN doc_id % 31 = 0 THEN doc_id - 1 ELSE doc_id END AS STRING)) AS number,
            CASE WHEN doc_id % 37 = 0 THEN NULL ELSE number END AS po_number, CASE WHEN doc_id % 41 = 0 THEN vendor_id + 1 ELSE vendor_id END AS vendor_id,
            'USD' AS currency, doc_date, total, CASE WHEN doc_id % 43 = 0 THEN 45 ELSE 30 END AS terms
        FROM {po_header}""",
    "inv_lines": """
        SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN concat(sku, '-X') ELSE lower(sku) END AS sku, description,
            CASE WHEN doc_id % 11 = 0 THEN quantity + 1 ELSE quantity END AS quantity,
            CASE WHEN doc_id % 7 = 0 THEN CAST(unit_price * 1.08 AS DECIMAL(18,4)) WHEN doc_id % 47 = 0 THEN NULL ELSE unit_price END AS unit_price,
            CAST(CASE WHEN doc_id % 14 = 0 THEN 0.5 ELSE 0.98 END AS DECIMAL(5,4)) AS confidence
        FROM {po_lines}""",
    "dn_lines": """
        SELECT doc_id, sku, description, CASE WHEN doc_id % 13 = 0 THEN quantity - 1 ELSE quantity END AS quantity, confidence
        FROM {po_lines} WHERE doc_id % 53 <> 0""",
    # Vendors, and the names that documents print for them.
    "vendors": """
        SELECT s_suppkey AS vendor_id, concat('Kestrel & Sons ', CAST(s_suppkey AS STRING), ' Inc.') AS name,
            concat('de ', CAST(s_suppkey * 7 AS STRING), '-', CAST(s_nationkey AS STRING)) AS tax_id, s_nationkey AS nation, 'USD' AS currency
        FROM {supplier}""",
    "printed_vendors": """
        SELECT s_suppkey AS doc_id, CASE s_suppkey % 5 WHEN 0 THEN concat('KESTREL and SONS ', CAST(s_suppkey AS STRING), ' LLC')
            WHEN 1 THEN concat('Kestrel & Sons ', CAST(s_suppkey AS STRING)) WHEN 2 THEN concat('Kestrel & Sons, ', CAST(s_suppkey AS STRING), ' Co. Ltd.')
            WHEN 3 THEN 'Unknown Trading' ELSE '' END AS name,
            CASE WHEN s_suppkey % 5 = 3 THEN concat('DE', CAST(s_suppkey * 7 AS STRING), ' ', CAST(s_nationkey AS STRING)) END AS tax_id
        FROM {supplier}""",
    # Work: jobs, review tasks, activity, model calls, from the event stream.
    "jobs": """
        SELECT event_id AS job_id, event_type AS job_type, user_id AS owner, ts AS created_at, value AS seconds,
            CASE WHEN event_id % 10 < 7 THEN 'SUCCEEDED' WHEN event_id % 10 = 7 THEN 'FAILED' WHEN event_id % 10 = 8 THEN 'QUEUED' ELSE 'RUNNING' END AS status,
            CAST(event_id % 3 AS INT) AS priority, CAST(event_id % 4 AS INT) AS attempts, CAST(user_id % 5 AS INT) AS department
        FROM {events}""",
    "tasks": """
        SELECT event_id AS task_id, event_id % 997 AS doc_id, CASE WHEN event_id % 3 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS state,
            CASE WHEN event_id % 4 = 0 THEN 'URGENT' WHEN event_id % 4 = 1 THEN 'HIGH' WHEN event_id % 4 = 2 THEN 'NORMAL' ELSE 'LOW' END AS priority,
            event_type AS task_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS assignee, ts AS created_at,
            CASE WHEN event_id % 6 = 0 THEN NULL ELSE ts + INTERVAL 2 DAY END AS due_at
        FROM {events}""",
    "files": """
        SELECT doc_id, concat('file_', CAST(doc_id AS STRING), '%.txt') AS filename, source AS owner, lang AS department, n_chars, text,
            CASE WHEN doc_id % 9 = 0 THEN TRUE ELSE FALSE END AS deleted,
            CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'INVOICE' ELSE 'CONTRACT' END AS document_type,
            CASE WHEN doc_id % 6 = 0 THEN 'FAILED' WHEN doc_id % 6 = 1 THEN 'PENDING' ELSE 'PROCESSED' END AS status,
            CAST(DATE '2026-01-01' + CAST(doc_id % 60 AS INT) AS DATE) AS created
        FROM {documents}""",
    "predictions": """
        SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN (quality = 1) = (doc_id % 8 <> 0) THEN 'good' ELSE 'bad' END AS label,
            CAST((50 + doc_id * 7 % 51) / 100.0 AS DECIMAL(5,4)) AS confidence
        FROM {labels}""",
    "versions": """
        SELECT doc_id, concat('policy-', CAST(doc_id % 50 AS STRING)) AS document_key, CAST(DATE '2024-01-01' + CAST(doc_id % 700 AS INT) AS DATE) AS effective_from,
            CASE WHEN doc_id % 4 = 0 THEN CAST(DATE '2024-06-01' + CAST(doc_id % 900 AS INT) AS DATE) END AS effective_to, lang AS category
        FROM {documents}""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The tables of a folder, and the views over them, by attribute: ``Tables(spark, folder).po_lines``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self.spark.sql(VIEWS[name], **{x: getattr(self, x) for x in set(re.findall(r"\{(\w+)\}", VIEWS[name]))})
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """``sql`` behind common table expressions for the views that it names, directly or not."""
    wanted: list[str] = []

    def want(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                want(re.sub(r"[{}]", "", VIEWS[name]))
                wanted.append(name)

    want(sql)
    parts = [f"{name} AS ({re.sub(r'[{}]', '', VIEWS[name])})" for name in wanted]
    if not parts:
        return sql
    head = sql.lstrip()
    if head.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(parts)}, {head[len('WITH RECURSIVE'):]}"
    return f"WITH {', '.join(parts)}{', ' + head[4:] if head.upper().startswith('WITH') else ' ' + head}"
