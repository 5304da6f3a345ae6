"""Aggregates of the dashboard, the queue and the evaluation suites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, retrieval
from .registry import query


@query("a01_count_by_type", "SELECT coalesce(document_type, 'UNCLASSIFIED') AS document_type, status, count(*) AS n FROM files WHERE NOT deleted GROUP BY ALL")
def _(t):
    return t.files.where("NOT deleted").groupBy(F.coalesce("document_type", F.lit("UNCLASSIFIED")).alias("document_type"), "status").agg(F.count("*").alias("n"))


@query("a02_processing_seconds", "SELECT count(*) AS n, round(avg(seconds), 6) AS mean, round(quantile_cont(seconds, 0.95), 6) AS p95, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM jobs WHERE status IN ('SUCCEEDED', 'FAILED')")
def _(t):
    done = t.jobs.where(F.col("status").isin("SUCCEEDED", "FAILED"))
    return done.agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("mean"), F.round(F.percentile("seconds", 0.95), 6).alias("p95"), F.count_if(F.col("status") == "FAILED").alias("failed"))


@query("a03_open_reviews", "SELECT priority, task_type, count(*) AS n, count(*) FILTER (WHERE due_at < TIMESTAMP '2024-01-15 00:00:00') AS overdue FROM tasks WHERE state = 'OPEN' GROUP BY ALL")
def _(t):
    late = F.col("due_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return t.tasks.where("state = 'OPEN'").groupBy("priority", "task_type").agg(F.count("*").alias("n"), F.count_if(late).alias("overdue"))


@query("a04_top_rules", "SELECT l_suppkey % 23 AS rule, count(DISTINCT l_orderkey) AS documents FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY documents DESC, rule LIMIT 8")
def _(t):
    found = t.lineitem.where("l_returnflag = 'R'").groupBy((F.col("l_suppkey") % 23).alias("rule")).agg(F.countDistinct("l_orderkey").alias("documents"))
    return found.orderBy(F.desc("documents"), "rule").limit(8)


@query("a05_count_by_json_path", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("a06_outcomes", "SELECT status, attempts, count(*) AS n FROM jobs GROUP BY ALL")
def _(t):
    return t.jobs.groupBy("status", "attempts").agg(F.count("*").alias("n"))


@query("a07_daily_gap_filled", """
    WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events WHERE user_id = 7 GROUP BY 1),
    s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT day, coalesce(n, 0) AS n, mean, coalesce(errors, 0) AS errors FROM s LEFT JOIN d USING (day)""")
def _(t):
    rows = t.events.where("user_id = 7")
    return metrics.daily_series(rows, F.to_date("ts"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors")).fillna(0, ["n", "errors"])


@query("a08_usage_by_day", """
    SELECT CAST(ts AS DATE) AS day, event_type AS provider, user_id % 3 AS model, count(*) AS calls, count(*) FILTER (WHERE event_id % 10 = 7) AS failed, coalesce(sum(CAST(value AS DECIMAL(18,6))) FILTER (WHERE event_id % 10 <> 7), 0) AS cost FROM events GROUP BY ALL""")
def _(t):
    good = F.when(F.col("event_id") % 10 != 7, F.col("value").cast("decimal(18,6)"))
    return t.events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("provider"), (F.col("user_id") % 3).alias("model")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("event_id") % 10 == 7).alias("failed"), F.coalesce(F.sum(good), F.lit(0)).alias("cost"))


@query("a09_queue_gauges", """
    WITH label AS (SELECT DISTINCT j.job_type, s.status FROM jobs j, (SELECT unnest(['QUEUED', 'RUNNING', 'FAILED', 'DEAD']) AS status) s)
    SELECT l.job_type, l.status, count(j.job_id) AS n, round(max(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(j.created_at)), 3) AS oldest FROM label l LEFT JOIN jobs j USING (job_type, status) GROUP BY ALL""")
def _(t):
    labels = t.jobs.select("job_type").distinct().withColumn("status", F.explode(F.array(*map(F.lit, ["QUEUED", "RUNNING", "FAILED", "DEAD"]))))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    age = (F.unix_micros(now) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    counts = t.jobs.groupBy("job_type", "status").agg(F.count("*").alias("n"), F.round(F.max(age), 3).alias("oldest"))
    return metrics.zero_filled(counts, labels, ["job_type", "status"], ["n"])


@query("a10_documents_by_status", "SELECT status, count(*) AS n, count(DISTINCT owner) AS owners FROM files WHERE NOT deleted GROUP BY status")
def _(t):
    return t.files.where("NOT deleted").groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"))


@query("a11_cost_today", "SELECT event_type AS provider, count(*) AS calls, sum(CAST(value AS DECIMAL(18,4))) AS cost FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05' GROUP BY 1")
def _(t):
    return t.events.where(F.to_date("ts") == F.lit("2024-01-05").cast("date")).groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(18,4)")).alias("cost"))


@query("a12_daily_budget", "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) > 2 AS over_budget FROM events")
def _(t):
    spent = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return t.events.select("event_id", (spent > 2).alias("over_budget"))


@query("a13_run_usage", "SELECT conv_id, sum(length(text))::BIGINT AS chars, count(*) AS turns FROM conversations GROUP BY conv_id")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("turns"))


@query("a14_document_frequency", """
    SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents WHERE lang = 'en') WHERE term <> '' GROUP BY term""")
def _(t):
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+", -1), lambda w: w != ""))
    return t.documents.where("lang = 'en'").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query("a15_status_pivot", "SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE l_returnflag = 'A') AS \"A\", count(*) FILTER (WHERE l_returnflag = 'N') AS \"N\", count(*) FILTER (WHERE l_returnflag = 'Z') AS \"Z\" FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).pivot("l_returnflag", ["A", "N", "Z"]).agg(F.count(F.lit(1))).fillna(0)


@query("a17_precision_recall", """
    SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall
    FROM (SELECT count(*) FILTER (WHERE truth = 'good' AND label = 'good') AS tp, count(*) FILTER (WHERE truth = 'bad' AND label = 'good') AS fp, count(*) FILTER (WHERE truth = 'good' AND label = 'bad') AS fn FROM predictions)""")
def _(t):
    is_ = lambda c, v: F.col(c) == v
    counts = t.predictions.agg(F.count_if(is_("truth", "good") & is_("label", "good")).alias("tp"), F.count_if(is_("truth", "bad") & is_("label", "good")).alias("fp"), F.count_if(is_("truth", "good") & is_("label", "bad")).alias("fn"))
    scored = metrics.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("tp", "fp", "fn", F.round(scored["precision"], 9).alias("precision"), F.round(scored["recall"], 9).alias("recall"))


@query("a18_classification_report", """
    WITH c AS (SELECT unnest(['good', 'bad']) AS class), x AS (SELECT class, count(*) FILTER (WHERE truth = class) AS support, count(*) FILTER (WHERE truth = class AND label = class) AS tp,
        count(*) FILTER (WHERE truth <> class AND label = class) AS fp, count(*) FILTER (WHERE truth = class AND label <> class) AS fn FROM c, predictions GROUP BY class)
    SELECT class, support, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM x""")
def _(t):
    return metrics.classification_report(t.predictions, "truth", "label").select("class", "support", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query("a18_confusion_matrix", "SELECT truth, count(*) FILTER (WHERE label = 'bad') AS bad, count(*) FILTER (WHERE label = 'good') AS good FROM predictions GROUP BY truth")
def _(t):
    return t.predictions.groupBy("truth").pivot("label", ["bad", "good"]).agg(F.count(F.lit(1))).fillna(0)


@query("a19_calibration_error", """
    SELECT round(sum(n * abs(conf - acc)) / sum(n), 9) AS ece FROM (SELECT greatest(1, ceil(confidence * 10)) AS bin, count(*) AS n, avg(confidence::DOUBLE) AS conf, avg((truth = label)::INT::DOUBLE) AS acc FROM predictions GROUP BY 1)""")
def _(t):
    return metrics.calibration_error(t.predictions, "confidence", (F.col("truth") == F.col("label")).cast("int")).select(F.round("ece", 9).alias("ece"))


@query("a20_reliability_bins", """
    SELECT least(9, floor(confidence * 10))::BIGINT AS bin, count(*) AS n, round(avg(confidence::DOUBLE), 9) AS confidence, round(avg((truth = label)::INT::DOUBLE), 9) AS accuracy FROM predictions GROUP BY 1""")
def _(t):
    bins = metrics.reliability(t.predictions, "confidence", (F.col("truth") == F.col("label")).cast("int"))
    return bins.select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


SWEEP = """SELECT round(g / 20.0, 9)::DOUBLE AS threshold, count(p.doc_id) AS n, count(*) FILTER (WHERE truth <> label) AS errors FROM range(0, 21) r(g) LEFT JOIN predictions p ON least(20, floor(confidence * 20)) >= g GROUP BY g"""


@query("a21_threshold_sweep", SWEEP)
def _(t):
    return metrics.threshold_sweep(t.predictions, "confidence", F.col("truth") != F.col("label")).select(F.round("threshold", 9).alias("threshold"), "n", "errors")


@query("a21_error_bounds")
def _(t):
    sweep = metrics.threshold_sweep(t.predictions, "confidence", F.col("truth") != F.col("label"))
    return sweep.withColumn("bound", metrics.error_bound("errors", "n"))


@query("a22_choose_threshold", f"SELECT min(threshold) AS threshold FROM ({SWEEP}) WHERE threshold >= 0.6 AND errors = 0")
def _(t):
    return metrics.choose_threshold(metrics.threshold_sweep(t.predictions, "confidence", F.col("truth") != F.col("label")), 0.6)


@query("a23_summary_stats", "SELECT event_type, round(avg(value), 6) AS mean, median(value) AS median, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


@query("a24_nearest_rank", """
    SELECT event_type, v[round_even(0.95 * (n - 1), 0)::INT + 1] AS p95 FROM (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY 1)""")
def _(t):
    return metrics.nearest_rank(t.events, ["event_type"], "value", 0.95, "p95")


@query("a25_throughput", """
    SELECT job_type, round(count(*) FILTER (WHERE status = 'SUCCEEDED') / (epoch(max(created_at)) - epoch(min(created_at))) * 60, 6) AS per_minute,
        round(count(*) FILTER (WHERE status = 'FAILED') / count(*), 9) AS failure_rate, sum(attempts)::BIGINT AS retries FROM jobs GROUP BY 1""")
def _(t):
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    return t.jobs.groupBy("job_type").agg(
        F.round(F.count_if(F.col("status") == "SUCCEEDED") / ((F.max(micros) - F.min(micros)) / 1e6) * 60, 6).alias("per_minute"),
        F.round(F.count_if(F.col("status") == "FAILED") / F.count("*"), 9).alias("failure_rate"), F.sum("attempts").alias("retries"))


@query("a26_defect_recall", """
    SELECT CASE WHEN doc_id % 7 = 0 THEN 'price' WHEN doc_id % 11 = 0 THEN 'quantity' ELSE 'none' END AS defect, count(*) AS n, count(*) FILTER (WHERE flagged) AS found
    FROM (SELECT i.doc_id, bool_or(i.unit_price <> p.unit_price OR i.quantity <> p.quantity) AS flagged FROM inv_lines i JOIN po_lines p ON i.doc_id = p.doc_id AND upper(i.sku) = upper(p.sku) GROUP BY 1) GROUP BY 1""")
def _(t):
    p = t.po_lines.select("doc_id", F.upper("sku").alias("key"), F.col("unit_price").alias("price"), F.col("quantity").alias("ordered"))
    flagged = t.inv_lines.withColumn("key", F.upper("sku")).join(p, ["doc_id", "key"]).groupBy("doc_id").agg(F.bool_or((F.col("unit_price") != F.col("price")) | (F.col("quantity") != F.col("ordered"))).alias("flagged"))
    defect = F.when(F.col("doc_id") % 7 == 0, "price").when(F.col("doc_id") % 11 == 0, "quantity").otherwise("none")
    return flagged.groupBy(defect.alias("defect")).agg(F.count("*").alias("n"), F.count_if("flagged").alias("found"))


@query("a27_ranking_metrics", """
    WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    r AS (SELECT q.vec_id AS query, e.label = q.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v))), 12) DESC, e.vec_id) AS rank
        FROM x e, x q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10),
    per AS (SELECT query, max((rank <= 5 AND hit)::INT) AS hit, sum((rank <= 5 AND hit)::INT) / 5 AS precision, max(CASE WHEN hit THEN 1.0::DOUBLE / rank ELSE 0 END) AS rr,
        sum(CASE WHEN rank <= 5 AND hit THEN 1 / log2(rank + 1.0) ELSE 0 END) / list_sum([1 / log2(i + 1.0) for i in range(1, least(5, sum(hit::INT))::BIGINT + 1)]) AS ndcg FROM r GROUP BY query)
    SELECT round(avg(hit), 9) AS hit, round(avg(precision), 9) AS precision, round(avg(rr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg FROM per""")
def _(t):
    """Vectors near every twentieth one, itself included; those of its label among them are the relevant ones."""
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("label").alias("wanted"))
    near = retrieval.nearest(t.embeddings.select("vec_id", "embedding"), queries, 10, "vec_id").select("query", F.col("vec_id").alias("item"), "rank")
    of = near.join(t.embeddings.select(F.col("vec_id").alias("item"), "label"), "item").join(queries.select("query", "wanted"), "query")
    per = metrics.ranking_metrics(near, of.where("label = wanted").select("query", "item"), "query", "item", "rank", 5)
    return per.agg(*[F.round(F.avg(a), 9).alias(b) for a, b in (("hit", "hit"), ("precision", "precision"), ("rr", "mrr"), ("ndcg", "ndcg"))])


@query("a28_refusal_rates", "SELECT truth, round(avg((confidence < 0.7)::INT), 9) AS refused FROM predictions GROUP BY truth")
def _(t):
    return t.predictions.groupBy("truth").agg(F.round(F.avg((F.col("confidence") < 0.7).cast("int")), 9).alias("refused"))


@query("a29_cell_accuracy", """
    SELECT 'quantity' AS cell, round(avg((i.quantity = p.quantity)::INT), 9) AS accuracy FROM inv_lines i JOIN po_lines p ON i.doc_id = p.doc_id AND upper(i.sku) = upper(p.sku)
    UNION ALL SELECT 'unit_price', round(avg((i.unit_price = p.unit_price)::INT), 9) FROM inv_lines i JOIN po_lines p ON i.doc_id = p.doc_id AND upper(i.sku) = upper(p.sku)""")
def _(t):
    p = t.po_lines.select("doc_id", F.upper("sku").alias("key"), F.struct("quantity", "unit_price").alias("want"))
    joined = t.inv_lines.withColumn("key", F.upper("sku")).join(p, ["doc_id", "key"])
    cells = joined.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), (F.col(c) == F.col(f"want.{c}")).alias("right")) for c in ("quantity", "unit_price")])).alias("x"))
    return cells.groupBy("x.cell").agg(F.round(F.avg(F.col("x.right").cast("int")), 9).alias("accuracy"))


@query("a30_weighted_confidence", "SELECT lang, round(sum((doc_id % 101 / 100.0)::DOUBLE * n_chars) / sum(n_chars), 9) AS confidence FROM documents GROUP BY lang")
def _(t):
    conf = F.col("doc_id") % 101 / F.lit(100.0)
    return t.documents.groupBy("lang").agg(F.round(F.sum(conf * F.col("n_chars")) / F.sum("n_chars"), 9).alias("confidence"))


@query("a31_findings_by_rank", """
    SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END) WHEN 3 THEN 'RESTRICTED' WHEN 2 THEN 'CONFIDENTIAL' ELSE 'INTERNAL' END AS level, count(*) AS findings, list(DISTINCT CAST(day(ts) AS INT) ORDER BY CAST(day(ts) AS INT)) AS pages FROM events GROUP BY 1""")
def _(t):
    level = F.when(F.col("event_type") == "error", F.struct(F.lit(3).alias("r"), F.lit("RESTRICTED").alias("l"))).when(F.col("event_type") == "purchase", F.struct(F.lit(2).alias("r"), F.lit("CONFIDENTIAL").alias("l"))).otherwise(F.struct(F.lit(1).alias("r"), F.lit("INTERNAL").alias("l")))
    return t.events.groupBy("user_id").agg(F.max(level)["l"].alias("level"), F.count("*").alias("findings"), F.sort_array(F.collect_set(F.dayofmonth("ts"))).alias("pages"))


@query("a32_consistency_by_field", "SELECT field, bool_or(passed) AS passed FROM (SELECT l_orderkey % 100 AS field, l_discount < 0.01 AS passed FROM lineitem UNION ALL SELECT l_partkey % 100, l_tax < 0.001 FROM lineitem) GROUP BY field")
def _(t):
    checks = t.lineitem.select(F.explode(F.array(F.struct((F.col("l_orderkey") % 100).alias("field"), (F.col("l_discount") < 0.01).alias("passed")), F.struct((F.col("l_partkey") % 100).alias("field"), (F.col("l_tax") < 0.001).alias("passed")))).alias("x"))
    return checks.groupBy("x.field").agg(F.bool_or("x.passed").alias("passed"))


@query("a33_document_confidence", "SELECT doc_id, coalesce(min(CASE WHEN unit_price IS NULL THEN 0 ELSE confidence END), 1) AS confidence FROM inv_lines GROUP BY doc_id")
def _(t):
    return t.inv_lines.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("unit_price").isNull(), 0).otherwise(F.col("confidence"))), F.lit(1)).alias("confidence"))


@query("a34_term_coverage", """
    WITH q AS (SELECT unnest(['the', 'of', 'apache', 'license']) AS term), d AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')) AS words FROM documents),
    w AS (SELECT term, ln(((SELECT count(*) FROM d) + 1) / ((SELECT count(*) FROM d WHERE list_contains(words, term)) + 0.5)) AS idf FROM q)
    SELECT doc_id, round(sum(CASE WHEN list_contains(words, term) THEN idf ELSE 0 END) / sum(idf), 6) AS coverage FROM d, w GROUP BY doc_id""")
def _(t):
    from ..operators import retrieval

    words = t.documents.select("doc_id", F.array_distinct(F.split(F.lower("text"), "[^a-z]+", -1)).alias("words"))
    return retrieval.term_coverage(words, "doc_id", "words", ["the", "of", "apache", "license"]).select("doc_id", F.round("coverage", 6).alias("coverage"))


@query("a35_next_version", "SELECT document_key, max(doc_id) + 1 AS next FROM versions GROUP BY 1")
def _(t):
    return t.versions.groupBy("document_key").agg((F.max("doc_id") + 1).alias("next"))


@query("a36_pages_per_version", "SELECT conv_id, turn, count(*) AS pages FROM conversations GROUP BY ALL")
def _(t):
    return t.conversations.groupBy("conv_id", "turn").agg(F.count("*").alias("pages"))


@query("a37_skew_of_slopes", "SELECT round(median(slope), 6) AS skew FROM (SELECT regr_slope(l_extendedprice, l_quantity) AS slope FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_quantity) > 1)")
def _(t):
    slopes = t.lineitem.groupBy("l_partkey").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"), F.countDistinct("l_quantity").alias("n")).where("n > 1")
    return slopes.agg(F.round(F.median("slope"), 6).alias("skew"))


@query("b07_regression_gates", """
    WITH m AS (SELECT 'accuracy' AS metric, avg((truth = label)::INT)::DOUBLE AS value FROM predictions UNION ALL SELECT 'mean_confidence', avg(confidence::DOUBLE) FROM predictions),
    g AS (SELECT * FROM (VALUES ('accuracy', 0.9::DOUBLE, NULL::DOUBLE), ('mean_confidence', 0.5, 0.9), ('latency', NULL, 3.0)) g(metric, minimum, maximum))
    SELECT metric, coalesce(value IS NOT NULL AND NOT isnan(value) AND coalesce(value >= minimum, TRUE) AND coalesce(value <= maximum, TRUE), FALSE) AS passed FROM g LEFT JOIN m USING (metric)""")
def _(t):
    found = t.predictions.agg(F.avg((F.col("truth") == F.col("label")).cast("int")).alias("accuracy"), F.avg(F.col("confidence").cast("double")).alias("mean_confidence")).unpivot([], ["accuracy", "mean_confidence"], "metric", "value")
    bounds = t.spark.sql("SELECT * FROM VALUES ('accuracy', 0.9D, CAST(NULL AS DOUBLE)), ('mean_confidence', 0.5D, 0.9D), ('latency', CAST(NULL AS DOUBLE), 3.0D) g(metric, minimum, maximum)")
    return metrics.gates(found, bounds).select("metric", "passed")


# ----------------------------------------------------------------- nested values, and time


@query("m01_json_text", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("m02_query_lexemes", "SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> ''))) AS lexemes FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.sort_array(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+", -1), lambda w: w != ""))).alias("lexemes"))


@query("m05_fields_to_header", """
    SELECT doc_id, max(CASE WHEN path = 'number' THEN value END) AS number, max(CASE WHEN path = 'currency' THEN value END) AS currency
    FROM (SELECT doc_id, 'number' AS path, number AS value FROM po_header UNION ALL SELECT doc_id, 'currency', currency FROM po_header) GROUP BY doc_id""")
def _(t):
    facts = t.po_header.unpivot("doc_id", ["number", "currency"], "path", "value")
    return facts.groupBy("doc_id").pivot("path", ["number", "currency"]).agg(F.max("value"))


@query("m04_field_path_access", "SELECT doc_id, sku FROM po_lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sku) = 3")
def _(t):
    rows = t.po_lines.groupBy("doc_id").agg(F.sort_array(F.collect_list("sku")).alias("lines"))
    return rows.select("doc_id", F.get("lines", F.lit(2)).alias("sku")).where("sku IS NOT NULL")


@query("m06_nested_lines", "SELECT doc_id, len(list(sku)) AS n, string_agg(sku, ',' ORDER BY sku) AS skus FROM po_lines GROUP BY doc_id")
def _(t):
    nested = t.po_lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sku", "quantity", "unit_price"))).alias("lines"))
    return nested.select("doc_id", F.size("lines").alias("n"), F.array_join(F.col("lines.sku"), ",").alias("skus"))


@query("m08_stage_timings", "SELECT stage, count(*) AS n, round(sum(v), 4) AS seconds FROM (SELECT 'extract' AS stage, value AS v FROM events UNION ALL SELECT 'index', value / 2 FROM events) GROUP BY stage")
def _(t):
    timings = t.events.select(F.explode(F.create_map(F.lit("extract"), F.col("value"), F.lit("index"), F.col("value") / 2)).alias("stage", "v"))
    return timings.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("seconds"))


@query("d07_fixed_bins", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS bin, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("bin"), "n")


@query("d08_utc_day", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("d09_epoch_seconds", "SELECT task_id, round(epoch(due_at) - epoch(created_at), 3) AS seconds FROM tasks")
def _(t):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return t.tasks.select("task_id", F.round((micros("due_at") - micros("created_at")) / 1e6, 3).alias("seconds"))
