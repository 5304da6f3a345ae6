"""Projections, predicates, joins, ordering and set operations over business documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import access, ranking, sets
from .registry import query


@query("f01_row_access", "SELECT doc_id FROM files WHERE NOT deleted AND (owner = 'src3' OR department = 'fr')")
def _(t):
    return access.visible(t.files, user="src3", department="fr").select("doc_id")


@query("f02_knowledge_visibility", "SELECT doc_id, document_type FROM files WHERE document_type IS NULL OR document_type = 'INVOICE'")
def _(t):
    return access.shared_or_own(t.files, "document_type", "INVOICE").select("doc_id", "document_type")


@query("f03_correction_wins", """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k') ELSE CAST(value AS VARCHAR) END IS NOT NULL AS has_value FROM events""")
def _(t):
    corrected = F.when(F.col("event_id") % 4 == 0, F.get_json_object("props", "$.k")).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", corrected.isNotNull().alias("has_value"))


PRINTED = "CASE doc_id % 5 WHEN 0 THEN concat('', n_chars) WHEN 1 THEN concat('-', n_chars, '.25') WHEN 2 THEN concat(n_chars, ' pages') WHEN 3 THEN '' ELSE text END"


@query("f04_guarded_cast", rf"""
    SELECT doc_id, CASE WHEN regexp_full_match(p, '-?[0-9]+(\.[0-9]+)?') THEN TRY_CAST(p AS DECIMAL(18,4)) END AS number,
        TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN '2026-02-' || CAST(doc_id % 40 AS VARCHAR) ELSE 'none' END AS DATE) AS day FROM (SELECT doc_id, {PRINTED} AS p FROM documents)""")
def _(t):
    printed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("2026-02-"), (F.col("doc_id") % 40).cast("string"))).otherwise("none")
    return t.documents.select("doc_id", access.number_or_null(F.expr(PRINTED)).alias("number"), access.date_or_null(printed).alias("day"))


@query("f05_operator_dispatch", """
    SELECT 'gt' AS op, count(*) AS n FROM po_header WHERE total > 100000 UNION ALL SELECT 'gte', count(*) FROM po_header WHERE total >= 100000
    UNION ALL SELECT 'lt', count(*) FROM po_header WHERE total < 100000 UNION ALL SELECT 'lte', count(*) FROM po_header WHERE total <= 100000
    UNION ALL SELECT 'eq', count(*) FROM po_header WHERE total = 100000""")
def _(t):
    head = t.po_header
    counts = head.agg(*[F.count_if(access.OPERATORS[op](F.col("total"), F.lit(100000))).alias(op) for op in access.OPERATORS])
    return counts.unpivot([], list(access.OPERATORS), "op", "n")


@query("f06_escaped_like", r"SELECT doc_id FROM files WHERE filename ILIKE '%1\%.T%' ESCAPE '\'")
def _(t):
    return t.files.where(access.contains_text("filename", "1%.T")).select("doc_id")


@query("f07_document_filters", """
    SELECT doc_id, created FROM files WHERE status = 'PROCESSED' AND document_type = 'INVOICE' AND owner = 'src8' AND created >= DATE '2026-01-10' AND created < DATE '2026-02-10'""")
def _(t):
    return access.document_filters(t.files, status="PROCESSED", document_type="INVOICE", owner="src8", since="2026-01-10", until="2026-02-10").select("doc_id", "created")


@query("f08_review_filters", """
    SELECT task_id FROM tasks WHERE state = 'OPEN' AND priority = 'HIGH' AND assignee IS NULL AND due_at < TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    return access.review_filters(t.tasks, state="OPEN", priority="HIGH", assigned="unassigned", overdue_at="2024-01-20 00:00:00").select("task_id")


@query("f09_audit_keyset", """
    SELECT event_id, event_type FROM events WHERE starts_with(event_type, 'p') AND event_id < 5000 ORDER BY event_id DESC LIMIT 51""")
def _(t):
    return access.audit_page(t.events, action="p.", id="event_id", action_column="event_type", before=5000, size=50, stem=True).select("event_id", "event_type")


@query("f10_audit_visibility", """
    SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
        OR CAST(event_id % 997 AS BIGINT) IN (SELECT doc_id FROM files WHERE department = 'fr')""")
def _(t):
    actors = t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    own = t.files.where("department = 'fr'").select(F.col("doc_id").alias("entity"))
    return access.any_semi_join(t.events.withColumn("entity", F.col("event_id") % 997), "event_id", [(actors, "user_id"), (own, "entity")]).select("event_id")


@query("f11_half_open_range", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-10 00:00:00'")
def _(t):
    return access.half_open(t.events, "ts", "2024-01-03 00:00:00", "2024-01-10 00:00:00").agg(F.count("*").alias("n"))


@query("f12_null_safe_department", "SELECT a.doc_id, count(*) AS n FROM files a JOIN (SELECT DISTINCT document_type FROM files) b ON a.document_type IS NOT DISTINCT FROM b.document_type GROUP BY a.doc_id")
def _(t):
    kinds = t.files.select(F.col("document_type").alias("k")).distinct()
    return t.files.join(kinds, F.col("document_type").eqNullSafe(F.col("k"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f13_temporal_validity", "SELECT doc_id FROM versions WHERE effective_from <= DATE '2025-01-01' AND (effective_to IS NULL OR effective_to >= DATE '2025-01-01')")
def _(t):
    return access.valid_on(t.versions, "2025-01-01").select("doc_id")


@query("f14_summary_predicate", """
    SELECT doc_id FROM (SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE l_returnflag = 'R') AS mismatch, count(*) FILTER (WHERE l_linestatus = 'F') AS missing FROM lineitem GROUP BY 1)
    WHERE mismatch + missing > 4""")
def _(t):
    summary = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.struct(F.count_if(F.col("l_returnflag") == "R").alias("mismatch"), F.count_if(F.col("l_linestatus") == "F").alias("missing")).alias("summary"))
    return summary.where(F.col("summary.mismatch") + F.col("summary.missing") > 4).select("doc_id")


@query("f15_array_containment", """
    WITH held AS (SELECT l_orderkey AS doc_id, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1)
    SELECT doc_id, list_contains(flags, 'R') AS has_r, len(list_filter(flags, lambda x: NOT list_contains(['A', 'N'], x))) = 0 AS within, list_has_any(flags, ['A']) AS touches FROM held""")
def _(t):
    held = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("l_returnflag").alias("flags"))
    two = F.array(F.lit("A"), F.lit("N"))
    return held.select("doc_id", F.array_contains("flags", "R").alias("has_r"), sets.subset("flags", two).alias("within"), F.arrays_overlap("flags", F.array(F.lit("A"))).alias("touches"))


@query("f16_regex_prefilter", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licensed under|apache')")
def _(t):
    return t.documents.where(F.col("text").rlike("(?i)licensed under|apache")).select("doc_id")


@query("f18_retention_cutoff", "SELECT doc_id FROM files WHERE NOT (deleted AND created < DATE '2026-02-01')")
def _(t):
    return access.after_retention(t.files, "doc_id", F.col("deleted") & (F.col("created") < F.lit("2026-02-01").cast("date"))).select("doc_id")


@query("f19_sensitivity_gate", """
    SELECT doc_id, CASE greatest(CAST(doc_id % 4 AS INT), CAST(n_chars % 3 AS INT)) WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' ELSE 'RESTRICTED' END AS level,
        greatest(CAST(doc_id % 4 AS INT), CAST(n_chars % 3 AS INT)) <= 1 AS may_leave FROM documents""")
def _(t):
    levels = F.array(*map(F.lit, access.SENSITIVITY))
    named = t.documents.select("doc_id", F.get(levels, (F.col("doc_id") % 4).cast("int")).alias("a"), F.get(levels, (F.col("n_chars") % 3).cast("int")).alias("b"))
    return access.gate(named, ["a", "b"], "INTERNAL").select("doc_id", "level", "may_leave")


# ---------------------------------------------------------------------------------- joins


@query("j01_tasks_with_documents", "SELECT task_id, filename FROM tasks JOIN files USING (doc_id) WHERE state = 'OPEN'")
def _(t):
    return t.tasks.where("state = 'OPEN'").join(t.files.select("doc_id", "filename"), "doc_id").select("task_id", "filename")


@query("j02_left_outer_names", "SELECT event_id, c_name AS actor FROM events LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 0")
def _(t):
    return t.events.join(t.customer.where("c_acctbal > 0"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.col("c_name").alias("actor"))


@query("j03_first_by_position", "SELECT o_orderkey AS doc_id, (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey)) AS first_part FROM orders")
def _(t):
    first = ranking.first_by(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey", "first_part")
    return t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("doc_id"), "first_part")


@query("j04_ordered_concat", "SELECT conv_id, string_agg(text, ' | ' ORDER BY turn, role, text) AS pages FROM conversations GROUP BY conv_id")
def _(t):
    return ranking.concat_in_order(t.conversations, "conv_id", ["turn", "role", "text"], "text", " | ", "pages")


@query("j05_semi_join", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def _(t):
    return t.supplier.join(t.lineitem.where("l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("j06_all_participants_visible", "SELECT DISTINCT l_orderkey AS doc_id FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey % 10 = 0)")
def _(t):
    seen = t.supplier.where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return sets.every_member(t.lineitem, "l_orderkey", "l_suppkey", seen).select(F.col("l_orderkey").alias("doc_id"))


@query("j07_related_documents", """
    WITH a AS (SELECT i.doc_id, i.number, i.po_number, i.total, i.vendor_id FROM inv_header i)
    SELECT count(*) AS n, count(DISTINCT x) AS docs FROM (
        SELECT l.doc_id AS x, r.doc_id AS y FROM a l JOIN a r ON l.number = r.number AND l.doc_id <> r.doc_id
        UNION SELECT l.doc_id, r.doc_id FROM a l JOIN a r ON l.total = r.total AND l.vendor_id = r.vendor_id AND l.doc_id <> r.doc_id
        UNION SELECT l.doc_id, r.doc_id FROM a l JOIN a r ON l.po_number = r.po_number AND l.doc_id <> r.doc_id)""")
def _(t):
    found = sets.related(t.inv_header, "doc_id", [["number"], ["total", "vendor_id"], ["po_number"]])
    return found.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("j08_referencing_lookup", "SELECT p.doc_id, list(i.doc_id ORDER BY i.doc_date, i.doc_id) AS invoices FROM po_header p JOIN inv_header i ON i.po_number = p.number GROUP BY p.doc_id")
def _(t):
    joined = t.po_header.select("doc_id", "number").join(t.inv_header.select(F.col("po_number").alias("number"), F.col("doc_id").alias("inv"), "doc_date"), "number")
    return joined.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_date", "inv"))), lambda x: x["inv"]).alias("invoices"))


WINDOWS = """
    SELECT document_key, doc_id, effective_from AS valid_from, least(coalesce(effective_to, DATE '9999-12-31'),
        coalesce(CAST(lead(effective_from) OVER (PARTITION BY document_key ORDER BY effective_from, doc_id) - 1 AS DATE), DATE '9999-12-31')) AS valid_to FROM versions"""


@query("j09_as_of_join", f"""
    WITH w AS ({WINDOWS}), asked AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
    SELECT day, document_key, max(doc_id) AS doc_id FROM asked JOIN w ON CAST(day + 300 AS DATE) BETWEEN valid_from AND valid_to GROUP BY day, document_key""")
def _(t):
    asked = t.events.select(F.to_date("ts").alias("day")).distinct()
    windows = ranking.validity_windows(t.versions, "document_key", "effective_from", "effective_to", "doc_id")
    joined = ranking.as_of_join(asked.withColumn("on", F.date_add("day", 300)), "on", windows)
    return joined.groupBy("day", "document_key").agg(F.max("doc_id").alias("doc_id"))


@query("j16_same_file", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS original FROM documents")
def _(t):
    return sets.oldest_copy(t.documents.withColumn("sha256", F.sha2("text", 256)), "sha256", "doc_id", "original").select("doc_id", "original")


@query("j19_batched_lookup", "SELECT task_id, n_name FROM tasks JOIN customer ON assignee = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    return t.tasks.join(t.customer, F.col("assignee") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("task_id", "n_name")


@query("j20_cited_sources", """
    WITH cited AS (SELECT doc_id, unnest(string_split(text, ' ')) AS label FROM documents)
    SELECT c.doc_id, c.label, count(*) AS n FROM cited c JOIN (SELECT DISTINCT lang AS label FROM documents UNION SELECT 'The') s USING (label) GROUP BY ALL""")
def _(t):
    labels = t.documents.select(F.col("lang").alias("label")).distinct().union(t.spark.sql("SELECT 'The'"))
    cited = t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("label"))
    return cited.join(labels, "label").groupBy("doc_id", "label").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------ ordering, windows


@query("w01_page_and_total", "SELECT doc_id, (SELECT count(*) FROM files) AS total FROM files ORDER BY created DESC, doc_id LIMIT 20 OFFSET 40")
def _(t):
    return ranking.page(t.files, [F.desc("created"), "doc_id"], offset=40, size=20).select("doc_id", "total")


@query("w02_queue_order", """
    SELECT task_id, row_number() OVER (ORDER BY (state = 'OPEN') DESC, CASE priority WHEN 'URGENT' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'NORMAL' THEN 2 ELSE 3 END, due_at ASC NULLS LAST, created_at DESC, task_id) AS place
    FROM tasks QUALIFY place <= 100""")
def _(t):
    return ranking.review_order(t.tasks, limit=100).select("task_id", "place")


@query("w03_keyset_page", "SELECT event_id FROM events WHERE event_id < 700 ORDER BY event_id DESC LIMIT 26")
def _(t):
    return ranking.keyset_page(t.events, "event_id", before=700, size=25).select("event_id")


@query("w04_top_k_ties", """
    SELECT l_returnflag, l_orderkey, l_partkey FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_partkey, l_quantity FROM lineitem)
    QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_partkey) <= 5""")
def _(t):
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_partkey", "l_quantity").distinct()
    return ranking.top_per_group(rows, ["l_returnflag"], [F.desc("l_quantity"), "l_orderkey", "l_partkey"], 5).select("l_returnflag", "l_orderkey", "l_partkey")


@query("w05_latest_per_group", "SELECT owner, job_id FROM jobs QUALIFY row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, job_id DESC) = 1")
def _(t):
    return ranking.latest(t.jobs, ["owner"], ["created_at", "job_id"]).select("owner", "job_id")


@query("w06_best_passage", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, role, text) = 1")
def _(t):
    return ranking.top_per_group(t.conversations, ["conv_id"], [F.desc(F.length("text")), "turn", "role", "text"], 1).select("conv_id", "turn")


@query("w07_claim_order", "SELECT job_id FROM jobs WHERE status = 'QUEUED' ORDER BY priority DESC, created_at, job_id LIMIT 50")
def _(t):
    return t.jobs.where("status = 'QUEUED'").orderBy(F.desc("priority"), "created_at", "job_id").limit(50).select("job_id")


@query("w08_validity_windows", f"SELECT document_key, doc_id, valid_from, valid_to FROM ({WINDOWS})")
def _(t):
    return ranking.validity_windows(t.versions, "document_key", "effective_from", "effective_to", "doc_id").select("document_key", "doc_id", "valid_from", "valid_to")


@query("w09_newest_version", "SELECT document_key, max_by(doc_id, effective_from * 1) AS doc_id FROM (SELECT document_key, doc_id, CAST(epoch(effective_from) AS BIGINT) * 1000000 + doc_id AS effective_from FROM versions) GROUP BY 1")
def _(t):
    return ranking.latest(t.versions, ["document_key"], ["effective_from", "doc_id"]).select("document_key", "doc_id")


@query("w12_item_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_type, event_id) AS place FROM events")
def _(t):
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(rank, "event_type", "event_id")).alias("place"))


@query("w13_merge_consecutive", """
    WITH kept AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events WHERE event_type <> 'error'),
    island AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS grp FROM kept)
    SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM island GROUP BY user_id, grp""")
def _(t):
    days = t.events.where("event_type <> 'error'").select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day")).distinct()
    return ranking.islands(days, ["user_id"], "day").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("island")


@query("w13_budget_prefix", """
    SELECT conv_id, count(*) AS kept FROM (SELECT conv_id, coalesce(sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) WHERE upto <= 120 OR rn = 1 GROUP BY conv_id""")
def _(t):
    return ranking.within_budget(t.conversations, ["conv_id"], ["turn", "role", "text"], F.ceil(F.length("text") / 4), 120).groupBy("conv_id").agg(F.count("*").alias("kept"))


# ---------------------------------------------------------------------------------- sets


@query("o01_union_of_counts", "SELECT 'orders' AS term, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def _(t):
    return t.orders.agg(F.lit("orders").alias("term"), F.count("*").alias("n")).unionByName(t.events.agg(F.lit("events").alias("term"), F.count("*").alias("n")))


@query("o02_set_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def _(t):
    return t.part.select("p_partkey").join(t.lineitem.where("l_quantity > 40"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").distinct()


@query("o03_intersection_count", "SELECT count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')")
def _(t):
    of = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id")
    return of("error").intersect(of("purchase")).agg(F.count("*").alias("n"))


@query("o04_bag_overlap", """
    WITH w AS (SELECT conv_id, turn % 2 AS side, unnest(string_split(lower(text), ' ')) AS word FROM conversations),
    c AS (SELECT conv_id, word, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM w GROUP BY ALL)
    SELECT conv_id, sum(least(a, b))::BIGINT AS shared FROM c GROUP BY conv_id""")
def _(t):
    words = t.conversations.select("conv_id", (F.col("turn") % 2).alias("side"), F.explode(F.split(F.lower("text"), " ", -1)).alias("word"))
    return sets.bag_overlap(words, ["conv_id"], "word", F.col("side") == 0).select("conv_id", "shared")


@query("o05_ordered_distinct", "SELECT conv_id, list(role ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def _(t):
    rows = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select("conv_id", F.array_distinct(F.transform("x", lambda r: r["role"])).alias("roles"))


@query("o06_change_set", """
    SELECT coalesce(a.sku, b.sku) AS sku, CASE WHEN a.sku IS NULL THEN 'ADDED' ELSE 'REMOVED' END AS change, count(*) AS n
    FROM (SELECT doc_id, upper(sku) AS sku FROM po_lines WHERE doc_id % 50 <> 1) a FULL JOIN (SELECT doc_id, upper(sku) AS sku FROM inv_lines WHERE doc_id % 51 <> 2) b ON a.doc_id = b.doc_id AND a.sku = b.sku
    WHERE a.sku IS NULL OR b.sku IS NULL GROUP BY ALL""")
def _(t):
    old = t.po_lines.where("doc_id % 50 <> 1").select("doc_id", F.upper("sku").alias("sku"))
    new = t.inv_lines.where("doc_id % 51 <> 2").select("doc_id", F.upper("sku").alias("sku"))
    return sets.changes(old, new, ["doc_id", "sku"]).groupBy("sku", "change").agg(F.count("*").alias("n"))


@query("o07_numbers_within", """
    SELECT doc_id, len(list_filter(regexp_extract_all(substr(text, length(text) // 2 + 1), '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(left(text, length(text) // 2), '[0-9]+'), x))) = 0 AS grounded FROM documents""")
def _(t):
    """Numbers of the second half of a text that the first half has, too."""
    numbers = lambda c: F.regexp_extract_all(F.expr(c), F.lit("([0-9]+)"))
    return t.documents.select("doc_id", sets.subset(numbers("substring(text, length(text) div 2 + 1)"), numbers("left(text, length(text) div 2)")).alias("grounded"))


@query("o08_distinct_ids", "SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_discount > 0.05")
def _(t):
    return t.lineitem.where("l_discount > 0.05").select(F.col("l_orderkey").alias("doc_id")).distinct()
