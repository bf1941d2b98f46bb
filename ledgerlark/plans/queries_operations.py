"""Queries over operations: the product index, retries, stage times, tables that change in place, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, variant
from ..functions.text import char_count
from ..operators import analytics, catalogue, costs, documents, ocr, stock, terms
from ..sources import files, sinks
from ..sources.workspace import workspace
from ..streaming import retries, stage_times
from . import chain, views
from .views import LOGS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_TIME = "yyyy-MM-dd HH:mm:ss"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# ---- products: every second vector with some entries lost is a product, and all vectors are items ----

_PRODUCTS_SQL = """i AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT vec_id + 1000000 AS product_id, list_transform(range(1, len(embedding) + 1), lambda j: CASE WHEN (j + vec_id) % 11 = 0 THEN 0::DOUBLE ELSE embedding[j]::DOUBLE END) AS v FROM embeddings WHERE vec_id % 2 = 0),
s AS (SELECT item_id, product_id, round(list_cosine_similarity(i.v, p.v), 9) AS c FROM i CROSS JOIN p),
m AS (SELECT item_id, product_id, c FROM s WHERE c >= 0.92 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY c DESC, product_id) = 1)"""


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = views.table(spark, sf_dir, "embeddings")
    worn = F.transform("embedding", lambda x, j: F.when((j + 1 + F.col("vec_id")) % 11 == 0, 0.0).otherwise(x.cast("double")))
    products = e.where("vec_id % 2 = 0").select((F.col("vec_id") + 1000000).alias("product_id"), worn.alias("v"))
    items, path = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), workspace(spark, "products")
    catalogue.build_index(products, path)
    return items, catalogue.match_items(items, path)


@query(f"WITH {_PRODUCTS_SQL} SELECT item_id, product_id, round(c, 6) AS cosine FROM m")
def sku_cosine_match(spark, sf_dir):
    return _matches(spark, sf_dir)[1].withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {_PRODUCTS_SQL} SELECT item_id FROM i WHERE item_id NOT IN (SELECT item_id FROM m)")
def unmatched_items(spark, sf_dir):
    return catalogue.unmatched_items(*_matches(spark, sf_dir))


# ---- syncs: the events of a user on a day are the attempts of a document, errors are failures ----

_SYNC_SQL = """s AS (SELECT user_id || '-' || CAST(ts AS DATE) AS document_id, event_id, date_trunc('second', ts) AS moment, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'OK' END AS status FROM events
  WHERE event_type <> 'view' OR event_id % 5 = 0),"""


def _syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").where("event_type <> 'view' or event_id % 5 = 0").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.concat_ws("-", "user_id", F.col("ts").cast("date")).alias("document_id"), "event_id", F.date_trunc("second", "ts").alias("at"), F.when(F.col("event_type") == "error", "FAILED").otherwise("OK").alias("status"))


@query(f"""WITH {_SYNC_SQL} l AS (SELECT document_id, arg_max(status, event_id) AS s, count(*) AS n FROM s GROUP BY document_id)
SELECT document_id, n AS attempts FROM l WHERE s = 'FAILED' AND n < 5""")
def sync_retries(spark, sf_dir):
    attempt = F.row_number().over(W.partitionBy("document_id").orderBy("event_id"))
    return analytics.due_retries(_syncs(spark, sf_dir).withColumn("attempt", attempt)).withColumn("attempts", F.col("attempts").cast("long"))


@query(f"""WITH {_SYNC_SQL.replace("CAST(ts AS DATE)", "strftime(ts, '%Y-%m')")} r AS (SELECT *, count(*) FILTER (status = 'OK') OVER o AS run, row_number() OVER o AS k FROM s WINDOW o AS (PARTITION BY document_id ORDER BY moment, status ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN status = 'FAILED' THEN (row_number() OVER (PARTITION BY document_id, run, status ORDER BY moment) - 1) % 5 + 1 END AS n FROM r),
x AS (SELECT *, min(CASE WHEN status = 'OK' OR n = 5 THEN moment END) OVER (PARTITION BY document_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reset, time_bucket(INTERVAL 15 MINUTE, moment) + INTERVAL 15 MINUTE AS slot FROM f)
SELECT document_id, CAST(n AS INTEGER) AS attempt, strftime(moment, '%Y-%m-%d %H:%M:%S') AS "at", 'GIVE_UP' AS action FROM x WHERE n = 5
UNION ALL SELECT document_id, CAST(arg_max(n + 1, (moment, n)) AS INTEGER), strftime(slot, '%Y-%m-%d %H:%M:%S'), 'RETRY' FROM x WHERE status = 'FAILED' AND n < 5 AND (reset IS NULL OR reset >= slot) GROUP BY document_id, slot""")
def sync_retry_schedule(spark, sf_dir):
    month = F.concat_ws("-", F.regexp_extract("document_id", "^[0-9]+", 0), F.date_format("at", "yyyy-MM"))
    return retries.retry_plan(_syncs(spark, sf_dir).withColumn("document_id", month)).withColumn("at", F.date_format("at", _TIME))


# ---- stage times: a log row ends its stage, which began as many milliseconds before as its value says ----

_TIMES_SQL = f"""{LOGS_SQL}, t AS (SELECT id, stage, created_at - (CAST(floor(value * 500) AS BIGINT) * INTERVAL 1 MILLISECOND) AS started_at, CAST(id AS BIGINT) % 10 = 0 AS lost, created_at AS ended_at FROM (SELECT l.*, e.value FROM logs l JOIN events e ON lpad(CAST(e.event_id AS VARCHAR), 12, '0') = l.id))"""


def _stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth stage never ends."""
    e = views.table(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), "value")
    rows = views.logs(spark, sf_dir).join(e, "id").withColumn("attempt", F.col("id").cast("long"))
    began = F.timestamp_micros(F.unix_micros("created_at") - F.floor(F.col("value") * 500) * 1000)
    starts = rows.select("document_id", "stage", "attempt", began.alias("started_at"))
    ends = rows.where("attempt % 10 <> 0").select("document_id", "stage", "attempt", F.col("created_at").alias("ended_at"))
    return stage_times.matched(starts, ends)


@query(f"""WITH {_TIMES_SQL}, w AS (SELECT stage, CASE WHEN NOT lost THEN epoch_us(ended_at) // 1000 - epoch_us(started_at) // 1000 END AS ms, unnest([time_bucket(INTERVAL 30 MINUTE, started_at), time_bucket(INTERVAL 30 MINUTE, started_at) - INTERVAL 30 MINUTE]) AS start FROM t)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, stage, count(*) AS n, count(*) - count(ms) AS open, round(avg(ms), 6) AS avg_ms, coalesce(avg(ms) > 20000, false) AS alert FROM w GROUP BY start, stage""")
def stage_time_alerts(spark, sf_dir):
    return stage_times.slow_stages(_stage_times(spark, sf_dir)).withColumn("avg_ms", F.round("avg_ms", 6)).withColumn("start", F.date_format("start", _TIME))


@query(f"""WITH {LOGS_SQL}, c AS (SELECT id, document_id, 100 * CAST(json_extract_string(payload, '$.total_tokens') AS BIGINT) AS total_tokens FROM logs WHERE stage = 'AI_STRUCTURING')
SELECT id, document_id, total_tokens FROM c WHERE total_tokens > 8000""")
def token_budget_alerts(spark, sf_dir):
    tokens = 100 * F.get_json_object("payload", "$.total_tokens").cast("long")
    return stage_times.over_budget(views.logs(spark, sf_dir).where("stage = 'AI_STRUCTURING'").select("id", "document_id", tokens.alias("total_tokens")))


@query("""WITH u AS (SELECT user_id || '-' || CAST(ts AS DATE) AS document_id, min(ts) FILTER (event_type = 'view') AS uploaded_at, max(ts) FILTER (event_type = 'purchase') AS completed_at FROM events GROUP BY 1)
SELECT document_id, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at, CASE WHEN ok THEN strftime(completed_at, '%Y-%m-%d %H:%M:%S') END AS completed_at, CASE WHEN ok THEN epoch_us(completed_at) // 1000 - epoch_us(uploaded_at) // 1000 END AS ms
FROM (SELECT *, completed_at >= uploaded_at AND completed_at <= uploaded_at + INTERVAL 6 HOUR AS ok FROM u WHERE uploaded_at IS NOT NULL)""")
def completion_times(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("document_id", F.concat_ws("-", "user_id", F.col("ts").cast("date")))
    uploads = e.where("event_type = 'view'").groupBy("document_id").agg(F.min("ts").alias("uploaded_at"))
    completions = e.where("event_type = 'purchase'").groupBy("document_id").agg(F.max("ts").alias("completed_at"))
    rows = stage_times.completion_times(uploads, completions, "6 hours")
    return rows.withColumns({c: F.date_format(c, _TIME) for c in ("uploaded_at", "completed_at")})


# ---- documents that change in place: orders are uploads, their lines bring texts, states and deletions ----


def _documents(spark: SparkSession, sf_dir: str):
    """The table after batches that come out of order, one of them twice, with a compaction between."""
    o, l = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "lineitem")
    own = l.withColumn("id", F.col("l_orderkey").cast("string")).withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    texts = own.where("l_linenumber = 3").groupBy("id", "seq").agg(F.concat(F.lit("line of "), F.max("l_partkey").cast("string")).alias("raw_ocr_text"), F.when(F.max("l_suppkey") % 2 == 0, "ocr").otherwise("digital_pdf").alias("source_type"))
    states = own.where("l_linenumber in (2, 4)").groupBy("id", "seq").agg(F.when(F.max("l_partkey") % 3 == 0, "COMPLETED").when(F.max("l_partkey") % 3 == 1, "REVIEW_REQUIRED").otherwise("FAILED").alias("status"))
    uploads = o.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") * 10).alias("seq"), F.concat(F.lit("invoice_"), "o_orderkey", F.lit(".pdf")).alias("filename"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    gone = own.where("l_linenumber = 6").groupBy("id", "seq").agg(F.max("l_shipdate").cast("timestamp").alias("deleted_at"))
    table = documents.documents_table(spark, workspace(spark, "documents"))
    documents.set_status(table, states, "3")
    documents.store_extraction(table, texts, "2")
    table.compact()
    table.delete(gone, "4")
    documents.store_uploads(table, uploads, "1")
    documents.store_extraction(table, texts, "2")
    return table


_DOCUMENTS_SQL = """x AS (SELECT o_orderkey AS k, o_orderdate AS created_at,
  (SELECT max(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2) AS p2, (SELECT max(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 4) AS p4,
  (SELECT 'line of ' || max(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) AS text, (SELECT max(l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) AS s3,
  (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 6) AS deleted_at FROM orders),
d AS (SELECT CAST(k AS VARCHAR) AS id, 'invoice_' || k || '.pdf' AS filename, sha256(CAST(k AS VARCHAR)) AS file_hash, CASE WHEN s3 % 2 = 0 THEN 'ocr' WHEN s3 IS NOT NULL THEN 'digital_pdf' END AS source_type,
  CASE WHEN p4 IS NOT NULL THEN list_extract(['COMPLETED', 'REVIEW_REQUIRED', 'FAILED'], CAST(p4 % 3 + 1 AS INTEGER)) WHEN text IS NOT NULL THEN 'OCR_COMPLETED'
    WHEN p2 IS NOT NULL THEN list_extract(['COMPLETED', 'REVIEW_REQUIRED', 'FAILED'], CAST(p2 % 3 + 1 AS INTEGER)) ELSE 'UPLOADED' END AS status, text AS raw_ocr_text, created_at, deleted_at FROM x)"""


@query(f"WITH {_DOCUMENTS_SQL} SELECT id, filename, file_hash, source_type, status, raw_ocr_text, strftime(created_at, '%Y-%m-%d') AS created_at FROM d WHERE deleted_at IS NULL")
def documents_in_place(spark, sf_dir):
    return _documents(spark, sf_dir).read().withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query(f"""WITH {_DOCUMENTS_SQL} SELECT status, count(*) AS n, count(deleted_at) AS deleted FROM d WHERE coalesce(deleted_at, created_at) >= TIMESTAMP '1999-06-30' - INTERVAL 7 YEAR AND (CAST(id AS BIGINT) % 100 <> 0 OR deleted_at IS NOT NULL) GROUP BY status""")
def documents_after_retention(spark, sf_dir):
    table = _documents(spark, sf_dir)
    table.purge(lambda row: documents.expired(row, F.lit("1999-06-30").cast("date")))
    table.purge(lambda row: (row["id"].cast("long") % 100 == 0) & row["deleted_at"].isNull())
    table.vacuum()
    return table.read(deleted=True).groupBy("status").agg(F.count("*").alias("n"), F.count("deleted_at").alias("deleted"))


# ---- money: costs at all levels, cash by terms; goods: stock by day, purchases by store ----


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").join(views.table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    text = lambda prefix, n: F.concat(F.lit(prefix), (F.col("o_custkey") % n).cast("string"))
    tokens = F.col("l_quantity").cast("long")
    price = F.when(F.col("l_returnflag") == "A", "0.15").when(F.col("l_returnflag") == "N", "0.6").otherwise("2.5").cast("decimal(12,6)")
    return rows.select(F.when(F.col("o_custkey") % 5 != 4, text("org", 5)).alias("organization_id"), F.col("o_orderdate").cast("date").alias("day"), text("V", 97).alias("vendor"), F.col("o_orderkey").cast("string").alias("invoice_id"), (tokens * 100).alias("tokens"), F.when(F.col("l_linenumber") % 4 == 0, tokens * 50).alias("cached_tokens"), price.alias("price_per_1k"))


@query("""WITH c AS (SELECT CASE WHEN o_custkey % 5 <> 4 THEN 'org' || o_custkey % 5 END AS organization_id, CAST(o_orderdate AS DATE) AS day, 'V' || o_custkey % 97 AS vendor, CAST(o_orderkey AS VARCHAR) AS invoice_id,
  CAST(l_quantity AS BIGINT) * 100 AS tokens, CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_quantity AS BIGINT) * 50 ELSE 0 END AS cached_tokens,
  CAST(CASE l_returnflag WHEN 'A' THEN 0.15 WHEN 'N' THEN 0.6 ELSE 2.5 END AS DECIMAL(12,6)) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT grouping(organization_id, day, vendor, invoice_id) AS g, organization_id, day, vendor, invoice_id, count(*) AS calls, count(DISTINCT invoice_id) AS invoices, CAST(sum(tokens) AS BIGINT) AS tokens,
  sum(CAST(tokens AS DECIMAL(18,0)) * price * CAST(0.001 AS DECIMAL(4,3))) AS cost, sum(CAST(cached_tokens AS DECIMAL(18,0)) * price * CAST(0.001 AS DECIMAL(4,3))) AS saved
  FROM c GROUP BY GROUPING SETS ((), (organization_id), (organization_id, day), (organization_id, vendor), (organization_id, vendor, invoice_id)))
SELECT CASE g WHEN 15 THEN 'all' WHEN 7 THEN 'organization' WHEN 3 THEN 'day' WHEN 5 THEN 'vendor' WHEN 4 THEN 'invoice' END AS level, organization_id, day, vendor, invoice_id, calls, invoices, tokens,
  round(CAST(cost AS DOUBLE), 6) AS cost, round(CAST(saved AS DOUBLE), 6) AS saved, round(CAST(saved AS DOUBLE) / CAST(cost + saved AS DOUBLE), 9) AS saved_share FROM g""")
def cost_report(spark, sf_dir):
    return costs.cost_report(_calls(spark, sf_dir)).withColumns({"cost": F.round(F.col("cost").cast("double"), 6), "saved": F.round(F.col("saved").cast("double"), 6), "saved_share": F.round("saved_share", 9)})


@query("""WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey, CAST(l_quantity AS BIGINT) * 100 * CAST(CASE l_returnflag WHEN 'A' THEN 0.15 WHEN 'N' THEN 0.6 ELSE 2.5 END AS DECIMAL(12,6)) * CAST(0.001 AS DECIMAL(4,3)) AS cost FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT month, count(DISTINCT o_orderkey) AS invoices, round(CAST(sum(cost) AS DOUBLE), 6) AS cost, round(CAST(sum(cost) AS DOUBLE) / count(DISTINCT o_orderkey), 9) AS per_invoice FROM c GROUP BY month""")
def cost_per_invoice(spark, sf_dir):
    return costs.cost_per_invoice(_calls(spark, sf_dir)).withColumns({"cost": F.round(F.col("cost").cast("double"), 6), "per_invoice": F.round("per_invoice", 9)})


#: Fixed texts of terms by order, and what they mean: part, share up to and with it, kind of date, days, discount, days for it.
_TERMS = ["Net 30", "2/10 net 30", "EOM", "Net 15  E.O.M.", "50% in 30 days, 50% in 60 days", "30% due on receipt; 70% 1.5%/20 n/45", "31st of the following month", "as agreed"]
_MEANING = """m(k, part, before, upto, kind, days, discount, until) AS (VALUES (0, 1, 0, 100, 'days', 30, NULL, NULL), (1, 1, 0, 100, 'days', 30, 2, 10), (2, 1, 0, 100, 'end', 0, NULL, NULL), (3, 1, 0, 100, 'end', 15, NULL, NULL),
  (4, 1, 0, 50, 'days', 30, NULL, NULL), (4, 2, 50, 100, 'days', 60, NULL, NULL), (5, 1, 0, 30, 'days', 0, NULL, NULL), (5, 2, 30, 100, 'days', 45, 1.5, 20), (6, 1, 0, 100, 'next', 31, NULL, NULL), (7, 1, 0, 100, 'days', 30, NULL, NULL)),
t AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, part, discount, CAST(o_orderdate AS DATE) AS d, until, CASE kind WHEN 'days' THEN CAST(o_orderdate AS DATE) + days WHEN 'end' THEN last_day(o_orderdate) + days ELSE last_day(last_day(o_orderdate) + 1) END AS due,
  round(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(14,2)) * CAST(upto AS DECIMAL(5,0)) * CAST(0.01 AS DECIMAL(3,2)), 2) - round(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(14,2)) * CAST(before AS DECIMAL(5,0)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS amount
  FROM orders JOIN m ON k = o_orderkey % 8),
p AS (SELECT *, d + until AS discount_until, round(amount * (100 - CAST(discount AS DECIMAL(4,2))) * CAST(0.01 AS DECIMAL(3,2)), 2) AS discounted FROM t)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _TERMS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("date").alias("invoice_date"), said.alias("payment_terms"), F.col("o_totalprice").cast("decimal(14,2)").alias("grand_total"))
    return terms.payment_plan(o)


@query(f"WITH {_MEANING} SELECT id, part, due, CAST(amount AS DOUBLE) AS amount, discount_until, CAST(discounted AS DOUBLE) AS discounted FROM p")
def payment_plan(spark, sf_dir):
    return _plan(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("amount", "discounted")})


@query(f"WITH {_MEANING} SELECT CAST(date_trunc('week', due) AS DATE) AS week, CAST(sum(amount) AS DOUBLE) AS due, count(*) AS payments FROM p GROUP BY 1")
def cash_flow_by_terms(spark, sf_dir):
    return terms.cash_flow(_plan(spark, sf_dir)).withColumn("due", F.col("due").cast("double"))


@query(f"WITH {_MEANING} SELECT CAST(date_trunc('week', coalesce(discount_until, due)) AS DATE) AS week, CAST(sum(coalesce(discounted, amount)) AS DOUBLE) AS due, count(*) AS payments FROM p GROUP BY 1")
def cash_flow_paid_early(spark, sf_dir):
    return terms.cash_flow(_plan(spark, sf_dir), early=True).withColumn("due", F.col("due").cast("double"))


@query("""WITH o AS (SELECT 'Vendor ' || o_custkey % 97 AS vendor_name, CAST(o_orderdate AS DATE) AS d, list_extract(['Net 30', '2/10 net 30', 'EOM', 'Net 15  E.O.M.', '50% in 30 days, 50% in 60 days', NULL, 'Net 30', NULL], CAST(o_orderkey % 8 + 1 AS INTEGER)) AS t FROM orders),
n AS (SELECT vendor_name, t, count(*) AS n FROM o WHERE t IS NOT NULL GROUP BY vendor_name, t),
t AS (SELECT vendor_name, t FROM n QUALIFY row_number() OVER (PARTITION BY vendor_name ORDER BY n DESC, t) = 1)
SELECT vendor_name, count(*) AS invoices, min(d) AS first_day, max(d) AS last_day, round((max(d) - min(d)) / nullif(count(*) - 1, 0), 9) AS gap_days, any_value(t.t) AS usual_terms FROM o LEFT JOIN t USING (vendor_name) GROUP BY vendor_name""")
def vendor_habits(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, [*_TERMS[:5], None, "Net 30", None])), (F.col("o_orderkey") % 8 + 1).cast("int"))
    rows = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("Vendor "), F.col("o_custkey") % 97).alias("vendor_name"), F.col("o_orderdate").cast("date").alias("invoice_date"), said.alias("payment_terms"))
    return analytics.vendor_habits(rows).withColumn("gap_days", F.round("gap_days", 9))


@query("""WITH d AS (SELECT l_partkey % 50 AS product, CAST(l_shipdate AS DATE) AS day, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS BIGINT) AS moved FROM lineitem GROUP BY 1, 2),
s AS (SELECT product, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY product)
SELECT product, day, CAST(coalesce(moved, 0) AS BIGINT) AS moved, CAST(sum(coalesce(moved, 0)) OVER (PARTITION BY product ORDER BY day) AS BIGINT) AS stock FROM s LEFT JOIN d USING (product, day)""")
def running_stock(spark, sf_dir):
    moves = views.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("product"), F.col("l_shipdate").cast("date").alias("day"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"))
    return stock.running_stock(moves).withColumns({c: F.col(c).cast("long") for c in ("moved", "stock")})


@query("""WITH l AS (SELECT o_custkey % 20 AS store, l_partkey % 50 AS product, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_quantity, CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(14,2)) AS a FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT store, product, month, sum(l_quantity) AS quantity, CAST(sum(a) AS DOUBLE) AS amount FROM l GROUP BY ALL)
SELECT *, round(quantity / sum(quantity) OVER (PARTITION BY product, month), 9) AS share FROM g""")
def store_purchases(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").join(views.table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    lines = rows.select((F.col("o_custkey") % 20).alias("store"), (F.col("l_partkey") % 50).alias("product"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"))
    return stock.store_purchases(lines).withColumns({"amount": F.col("amount").cast("double"), "share": F.round("share", 9)})


# ---- the whole chain: orders are uploads, a text an order, and answers that a provider has saved ----

#: What the provider did by order, as a condition in SQL that both sides read.
_FAULTS = [("o_orderkey % 71 = 0", 401, None), ("o_orderkey % 73 = 0", 429, None), ("o_orderkey % 79 = 0", None, "timeout"), ("o_orderkey % 83 = 0", None, "connection reset"), ("o_orderkey % 89 = 0", 500, None)]
_MODELS = ("gpt-4o-mini", "gpt-4o-2024-08-06", "local")


def _chain(spark: SparkSession, sf_dir: str, root: str | None = None, **stages: str) -> dict[str, DataFrame]:
    k = F.col("o_orderkey")
    o = views.table(spark, sf_dir, "orders").withColumn("document_id", k.cast("string"))
    key = F.when(k % 59 == 0, k - 32).otherwise(k).cast("string")  # some uploads have the contents of another
    uploads = o.select("document_id", k.alias("ord"), F.concat(F.lit("invoice_"), k, F.lit(".pdf")).alias("filename"), F.when(k % 53 == 0, "text/html").otherwise("application/pdf").alias("content_type"), F.when(k % 61 == 0, 100).otherwise(2048 + k % 1000).alias("file_size_bytes"), F.sha2(key, 256).alias("file_hash"))
    text = F.when(k % 43 != 0, F.concat(F.lit("Invoice "), F.repeat(F.concat(k, F.lit(" ")), (1 + k % 97 * 50).cast("int"))))
    texts = o.where("o_orderkey % 47 <> 0").select("document_id", text.alias("text"), F.when(k % 4 == 0, "ocr").otherwise("digital_pdf").alias("source_type"), (k % 5 + 1).cast("int").alias("page_count"), ((k % 8) / 8).alias("mean_confidence"), (k % 900).cast("int").alias("duration_ms"), F.when(k % 41 == 0, "unreadable").alias("error"))
    bronze = views.extracted(spark, sf_dir)
    record = bronze.select("document_id", F.to_json(F.struct(*[c for c in bronze.columns if c not in ("document_id", "ord", "ocr_confidence")])).alias("content"))

    def answer(asked: DataFrame) -> DataFrame:
        status, fault = F.lit(200), F.lit(None).cast("string")
        for condition, code, what in reversed(_FAULTS):
            status, fault = F.when(F.expr(condition), code).otherwise(status), F.when(F.expr(condition), what).otherwise(fault)
        finish = F.when(k % 37 == 0, "length").when(k % 31 == 0, "content_filter").otherwise("stop")
        model = F.element_at(F.array(*map(F.lit, _MODELS)), (k % 3 + 1).cast("int"))
        message = F.struct(F.when(k % 29 != 0, F.col("content")).alias("content"), F.struct(F.lit(1).alias("twice")).alias("parsed"))
        response = F.to_json(F.struct(F.concat(F.lit("r"), k).alias("id"), F.array(F.struct(finish.alias("finish_reason"), message.alias("message"))).alias("choices")))
        sized = asked.select("document_id", char_count(F.col("prompt")).alias("input_tokens"))  # before the joins, which would move the prompts
        rows = sized.join(o.where("o_orderkey % 97 <> 0").select("document_id", "o_orderkey"), "document_id").join(record, "document_id")
        return rows.select("document_id", response.alias("response"), F.concat(F.lit("r"), k).alias("request_id"), model.alias("model"), finish.alias("finish_reason"), "input_tokens", (k % 700).cast("int").alias("output_tokens"), (k % 3000).cast("int").alias("latency_ms"), F.when(k % 23 == 0, "no").alias("refusal"), status.alias("http_status"), fault.alias("fault"))

    return chain.run_chain(uploads, texts, answer, root or workspace(spark, "chain"), **stages)


_CHAIN_SQL = f"""u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 59 = 0 THEN o_orderkey - 32 ELSE o_orderkey END AS h, o_orderkey % 53 = 0 OR o_orderkey % 61 = 0 AS refused FROM orders),
a AS (SELECT *, o_orderkey <> min(o_orderkey) OVER (PARTITION BY h) AS again FROM u WHERE NOT refused),
t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 47 = 0 THEN 'No extraction result.' WHEN o_orderkey % 41 = 0 THEN 'unreadable' WHEN o_orderkey % 43 = 0 THEN 'No text found on the document.' END AS text_error,
  8 + (len(CAST(o_orderkey AS VARCHAR)) + 1) * (1 + o_orderkey % 97 * 50) AS chars, CASE WHEN o_orderkey % 4 = 0 THEN 'ocr' ELSE 'digital_pdf' END AS source_type FROM a WHERE NOT again),
e AS (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN ['ERR_LLM_UNAVAILABLE', 'No answer.'] WHEN o_orderkey % 71 = 0 THEN ['ERR_LLM_AUTH_FAILED', 'OpenAI API returned HTTP 401.'] WHEN o_orderkey % 73 = 0 THEN ['ERR_LLM_RATE_LIMITED', 'OpenAI API returned HTTP 429.']
    WHEN o_orderkey % 79 = 0 THEN ['ERR_LLM_TIMEOUT', 'The AI provider did not answer in time.'] WHEN o_orderkey % 83 = 0 THEN ['ERR_LLM_UNAVAILABLE', 'connection reset'] WHEN o_orderkey % 89 = 0 THEN ['ERR_AI_STRUCTURING_FAILED', 'OpenAI API returned HTTP 500.']
    WHEN o_orderkey % 37 = 0 THEN ['ERR_LLM_INVALID_RESPONSE', 'AI response was truncated before completing the invoice schema.'] WHEN o_orderkey % 31 = 0 THEN ['ERR_LLM_INVALID_RESPONSE', 'AI response was blocked by the provider''s content filter.']
    WHEN o_orderkey % 23 = 0 THEN ['ERR_LLM_INVALID_RESPONSE', 'The AI provider refused to process this document.'] WHEN o_orderkey % 29 = 0 THEN ['ERR_LLM_INVALID_RESPONSE', 'AI response contained no parsed content.'] END AS ai_error,
  list_extract(['gpt-4o-mini', 'gpt-4o-2024-08-06', 'local'], CAST(o_orderkey % 3 + 1 AS INTEGER)) AS model, least(chars, 24000) + 90 + CASE WHEN o_orderkey % 4 = 0 THEN 25 ELSE 33 END AS tokens_in, o_orderkey % 700 AS tokens_out FROM t WHERE text_error IS NULL)"""


@query(f"""WITH {_CHAIN_SQL}
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'UPLOAD' AS stage, 'SUCCESS' AS status, 'Document received and stored.' AS message, 'invoice_' || o_orderkey || '.pdf' AS what, CAST(2048 + o_orderkey % 1000 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS INTEGER) AS duration_ms FROM t
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'TEXT_EXTRACTION', CASE WHEN text_error IS NULL THEN 'SUCCESS' ELSE 'FAILURE' END, coalesce(text_error, 'Text extracted via ' || source_type || '.'), CASE WHEN text_error IS NULL THEN source_type ELSE 'ERR_OCR_FAILED' END,
  CASE WHEN text_error IS NULL THEN CAST(chars AS BIGINT) END, CASE WHEN text_error IS NULL THEN o_orderkey % 8 / 8 END, CASE WHEN text_error IS NULL THEN CAST(o_orderkey % 900 AS INTEGER) END FROM t
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'AI_STRUCTURING', CASE WHEN ai_error IS NULL THEN 'SUCCESS' ELSE 'FAILURE' END, coalesce(ai_error[2], 'Structured by ' || model || '.'), coalesce(ai_error[1], CASE WHEN chars > 24000 THEN 'true' ELSE 'false' END),
  CASE WHEN ai_error IS NULL THEN CAST(tokens_in + tokens_out AS BIGINT) END, CASE WHEN ai_error IS NULL THEN round(CASE model WHEN 'gpt-4o-mini' THEN tokens_in * 0.15 + tokens_out * 0.6 WHEN 'gpt-4o-2024-08-06' THEN tokens_in * 2.5 + tokens_out * 10 END / 1e6, 9) END, CASE WHEN ai_error IS NULL THEN CAST(o_orderkey % 3000 AS INTEGER) END FROM e""")
def chain_logs(spark, sf_dir):
    """Logs of the first three stages with what their payloads say."""
    logs = _chain(spark, sf_dir, end="AI_STRUCTURING")["processing_logs"]
    read = lambda *paths: F.coalesce(*[variant.field(F.col("payload"), p, "string") for p in paths])
    what = read("$.error_code", "$.filename", "$.source_type", "$.ocr_text_truncated")
    n = read("$.file_size_bytes", "$.text_chars", "$.total_tokens").cast("long")
    x = F.round(F.coalesce(variant.field(F.col("payload"), "$.mean_confidence", "double"), variant.field(F.col("payload"), "$.estimated_cost_usd", "double")), 9)
    return logs.select("document_id", "stage", "status", "message", what.alias("what"), n.alias("n"), x.alias("x"), "duration_ms")


@query(f"""WITH {_CHAIN_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CASE WHEN o_orderkey % 53 = 0 THEN 'ERR_UNSUPPORTED_FORMAT' WHEN o_orderkey % 61 = 0 THEN 'ERR_EMPTY_FILE' ELSE 'ERR_DUPLICATE_DOCUMENT' END AS outcome FROM (SELECT o_orderkey FROM u WHERE refused UNION ALL SELECT o_orderkey FROM a WHERE again)
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'FAILED' FROM t LEFT JOIN e USING (o_orderkey) WHERE t.text_error IS NOT NULL OR ai_error IS NOT NULL
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'STORED' FROM e WHERE ai_error IS NULL""")
def chain_outcomes(spark, sf_dir):
    """What became of each upload; the chain stops after its texts and goes on from what it left."""
    root = workspace(spark, "chain")
    _chain(spark, sf_dir, root, end="TEXT_EXTRACTION")
    tables = _chain(spark, sf_dir, root, start="AI_STRUCTURING")
    stored = F.when(F.col("status") == "FAILED", "FAILED").otherwise("STORED").alias("outcome")
    return tables["rejected"].select("document_id", F.col("error_code").alias("outcome")).unionByName(tables["status"].select("document_id", stored))


@query("""SELECT conv_id, turn, '{"choices":[{"finish_reason":"stop","index":0,"message":{"content":' || to_json(coalesce(text, '')) || ',"role":' || to_json(role) || '}}],"id":' || conv_id || ',"usage":{"total_tokens":' || length(coalesce(text, '')) || '}}' AS raw FROM conversations WHERE role IS NOT NULL""")
def raw_responses(spark, sf_dir):
    """Turns as completions whose messages carry their content a second time as ``parsed``, stored without it."""
    rows = views.table(spark, sf_dir, "conversations").where("role is not null").withColumn("text", F.coalesce("text", F.lit("")))
    message = F.struct("role", F.col("text").alias("content"), F.struct(F.col("text").alias("again"), F.lit(1).alias("n")).alias("parsed"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    response = F.to_json(F.struct(F.col("conv_id").alias("id"), F.array(choice).alias("choices"), F.struct(F.length("text").alias("total_tokens")).alias("usage")))
    return rows.select("conv_id", "turn", variant.without_parsed(response).alias("raw"))


@query("""WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey % 7 = 0 AS failed, (1000 * 0.15 + (o_orderkey % 300) * 0.6) / 1e6 AS small, (1000 * 2.5 + (o_orderkey % 300) * 10) / 1e6 AS large FROM orders)
SELECT day, count(*) AS calls, count(*) FILTER (failed) AS retried, round(sum(small + CASE WHEN failed THEN large ELSE 0 END), 9) AS cost, round(sum(small + CASE WHEN failed THEN large ELSE 0 END) / count(*), 9) AS blended FROM c GROUP BY day""")
def tiered_costs(spark, sf_dir):
    tokens = F.col("o_orderkey") % 300
    cost = lambda model: numbers.estimated_cost(F.lit(model), F.lit(1000), tokens)
    calls = views.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 7 == 0).alias("failed"), cost("gpt-4o-mini").alias("cost_small"), cost("gpt-4o").alias("cost_large"))
    return costs.tiered_cost(calls).withColumns({"cost": F.round("cost", 9), "blended": F.round("blended", 9)})


@query(f"WITH {_PRODUCTS_SQL} SELECT label, count(*) AS items, count(m.item_id) AS matched, round(count(m.item_id) / count(*), 9) AS rate FROM i JOIN embeddings ON vec_id = i.item_id LEFT JOIN m ON m.item_id = i.item_id GROUP BY label")
def sku_match_rate(spark, sf_dir):
    """Share of items with a product, by label."""
    matched = _matches(spark, sf_dir)[1].select(F.col("item_id").alias("vec_id"), F.lit(1).alias("hit"))
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", "label").join(matched, "vec_id", "left")
    return rows.groupBy("label").agg(F.count("*").alias("items"), F.count("hit").alias("matched"), F.round(F.count("hit") / F.count("*"), 9).alias("rate"))


# ---- files: contents, annotations and a catalogue, written to a folder and read back ----


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, 'default') AS organization, CAST(2020 + doc_id % 5 AS VARCHAR) AS year, lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS month, sha256(coalesce(text, '')) AS file_hash FROM documents""")
def stored_files(spark, sf_dir):
    """Texts as files by organisation, year and month."""
    d, path = views.table(spark, sf_dir, "documents"), workspace(spark, "files")
    at = F.make_date((2020 + F.col("doc_id") % 5).cast("int"), (F.col("doc_id") % 12 + 1).cast("int"), F.lit(1)).cast("timestamp")
    rows = d.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("source", F.lit("default")).alias("organization"), at.alias("created_at"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    sinks.store_files(rows, path)
    schema = "id string, created_at timestamp, content binary, organization string, year string, month string"
    return spark.read.schema(schema).parquet(path).select("id", "organization", "year", "month", F.sha2("content", 256).alias("file_hash"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+') AS ws FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS page_count, CAST(len(ws) AS BIGINT) AS tokens, sha256(CASE WHEN len(ws) = 0 THEN '' ELSE array_to_string(ws, ' ') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'end' ELSE '' END END || CASE WHEN len(ws) = 0 AND doc_id % 3 = 0 THEN 'end' ELSE '' END) AS digest,
  round(CASE WHEN len(ws) = 0 THEN 0 ELSE 0.5 + doc_id % 2 / 4 END, 6) AS confidence FROM w""")
def saved_annotations(spark, sf_dir):
    """Annotations as an OCR service gives them, saved as JSON lines, read back and made into texts and tokens."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-zA-Z]+"), F.lit(0))
    corner = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    box = F.struct(F.array(corner, corner).alias("vertices"))
    word = lambda w: F.struct(F.array(F.struct(w.alias("text"))).alias("symbols"), (0.5 + F.col("doc_id") % 2 / 4).alias("confidence"), box.alias("boundingBox"))
    page = lambda ws: F.array(F.struct(F.array(F.struct(F.array(F.struct(F.transform(ws, word).alias("words"))).alias("paragraphs"))).alias("blocks")))
    first = F.struct(F.concat(F.lit(" "), F.array_join(words, " "), F.lit("\n")).alias("text"), page(words).alias("pages"))
    second = F.struct(F.lit("end").alias("text"), page(F.array().cast("array<string>")).alias("pages"))
    rows = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.when(F.col("doc_id") % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("annotations"))
    path = workspace(spark, "annotations")
    sinks.store_annotations(rows, path)
    return ocr.ocr_results(files.annotations(spark, path)).select("document_id", "page_count", F.size("tokens").cast("long").alias("tokens"), F.sha2("text", 256).alias("digest"), F.round("mean_confidence", 6).alias("confidence"))


@query("""SELECT 'SKU-' || vec_id AS sku, CASE WHEN vec_id % 3 = 0 THEN 'odd "name", with comma' ELSE 'product ' || vec_id END AS description, CASE WHEN vec_id % 5 <> 0 THEN 'cat' || label END AS category, CAST(vec_id % 1000 AS DOUBLE) / 4 AS unit_price,
  CAST(len(embedding) AS INTEGER) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings""")
def imported_catalogue(spark, sf_dir):
    """A catalogue as CSV with quoted names and embeddings as JSON, imported."""
    k, path = F.col("vec_id"), workspace(spark, "catalogue")
    name = F.when(k % 3 == 0, 'odd "name", with comma').otherwise(F.concat(F.lit("product "), k))
    rows = views.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("SKU-"), k).alias("sku"), name.alias("description"), F.when(k % 5 != 0, F.concat(F.lit("cat"), "label")).alias("category"), ((k % 1000).cast("double") / 4).alias("unit_price"), F.to_json("embedding").alias("embedding"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    found = files.catalogue(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("sku", "description", "category", "unit_price", F.size("embedding").alias("width"), F.round(total, 4).alias("total"))
