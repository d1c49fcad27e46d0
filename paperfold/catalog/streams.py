"""J: streams over the given tables; the SQL twin is the batch result."""

from pyspark.sql import functions as F

from paperfold.catalog.registry import query
from paperfold.operators.lookups import NO_MESSAGE
from paperfold.plans.pick import pick_last
from paperfold.sources.shared import new_path
from paperfold.streaming import jobs, learned, runs, states

LATE = "40 days"


def events(t):
    return runs.event_time(runs.stream_table(t.spark, t.folder, "events"))


def text_time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


SQL_JOBS = f"""e AS (SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'P100' WHEN 'view' THEN 'P300' WHEN 'click' THEN 'P400' WHEN 'purchase' THEN 'S100' ELSE CASE WHEN value > 30 THEN 'E300' ELSE 'E100' END END AS status,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN props END AS message, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
m(job_id, n, event_id, status, message, now, previous, reason) AS (
  SELECT job_id, n, event_id, status, message, status, NULL::VARCHAR, NULL::VARCHAR FROM e WHERE n = 1
  UNION ALL SELECT job_id, n, event_id, status, message, CASE WHEN reason IS NULL THEN status ELSE now END, now, reason FROM (
    SELECT e.*, m.now, CASE WHEN e.status = m.now THEN NULL WHEN m.now = 'E300' THEN 'cancelled' WHEN m.now = 'S100' THEN 'finished'
      WHEN m.now = 'E100' THEN CASE WHEN e.status <> 'P100' THEN 'failed' END WHEN e.status LIKE 'P%' AND e.status < m.now THEN 'backwards' END AS reason
    FROM m JOIN e ON e.job_id = m.job_id AND e.n = m.n + 1))"""


def job_transitions(t):
    kind = F.col("event_type")
    status = (F.when(kind == "signup", "P100").when(kind == "view", "P300").when(kind == "click", "P400").when(kind == "purchase", "S100")
              .when(F.col("value") > 30, "E300").otherwise("E100"))
    message = F.when((kind == "error") & (F.col("event_id") % 2 == 0), F.col("props"))
    src = events(t).select(F.col("user_id").alias("job_id"), "ts", "event_id", status.alias("status"), message.alias("message"))
    with runs.rocks(t.spark):
        return runs.run_append(states.job_transitions(src, LATE, 30), "job-transitions")


@query("j1_job_state", sql=f"""WITH RECURSIVE {SQL_JOBS},
l AS (SELECT job_id, max(n) FILTER (reason IS NULL) AS n, COUNT(*) FILTER (reason IS NULL) AS updates, COUNT(*) FILTER (reason IS NOT NULL) AS rejected FROM m GROUP BY 1)
SELECT job_id, status, CASE status WHEN 'E100' THEN COALESCE(message, '{NO_MESSAGE}') WHEN 'E300' THEN NULL ELSE message END AS message,
  CAST(updates AS BIGINT) AS updates, CAST(rejected AS BIGINT) AS rejected FROM l JOIN m USING (job_id, n)""")
def job_state(t):
    return jobs.job_state(job_transitions(t))


@query("j1_illegal_jumps", sql=f"""WITH RECURSIVE {SQL_JOBS} SELECT job_id, event_id, previous, status, reason FROM m WHERE reason IS NOT NULL""")
def illegal_jumps(t):
    """Updates that a job's state did not allow, with the reason."""
    return job_transitions(t).where(F.col("outcome") == states.REJECTED).select("job_id", "event_id", "previous", "status", "reason")


@query("j2_retention", sql="""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate + to_seconds((o_orderkey % 30 + 1) * 86400) > TIMESTAMP '1998-08-01'""")
def retention(t):
    from paperfold.functions.dates import expires_at

    src = runs.stream_table(t.spark, t.folder, "orders").withColumn("expires", expires_at(F.col("o_orderdate"), F.col("o_orderkey") % 30 + 1))
    return runs.run_append(jobs.unexpired(src, "expires", "1998-08-01").select("o_orderkey", "o_custkey"), "retention")


@query("j3_file_intake", sql="""
WITH f AS (SELECT COUNT(DISTINCT doc_id % 45) AS n, COUNT(*) AS docs FROM documents)
SELECT b AS batch_id, least(20, n - 20 * b) AS files, docs AS all_docs FROM (SELECT n, docs, unnest(range((n + 19) // 20)) AS b FROM f)""")
def file_intake(t):
    """At most 20 files per micro-batch; one row per batch, with what all batches have taken in."""
    folder = new_path(t.spark, "intake")
    # a file for each of 45 parts
    parts = t.documents.select("doc_id", (F.col("doc_id") % 45).cast("int").alias("part"))
    parts.repartitionById(45, "part").write.parquet(folder)
    src = runs.stream_folder(t.spark, folder, parts.schema, 20).select("doc_id", F.col("_metadata.file_path").alias("file"))
    per_file = runs.run_batches(src, "intake-batches", lambda b: b.groupBy("file").agg(F.count(F.lit(1)).alias("docs")))
    total = per_file.agg(F.sum("docs")).scalar()
    return per_file.groupBy("batch_id").agg(F.count(F.lit(1)).alias("files")).withColumn("all_docs", total)


@query("j4_live_trend", sql="""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(COUNT(*) AS BIGINT) AS total, CAST(COUNT(*) FILTER (event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY 1""")
def live_trend(t):
    out = runs.run_update(jobs.trend(events(t), "1 day", LATE), "trend", ["start"])
    return out.withColumn("start", text_time("start"))


@query("j5_request_rate", sql="""
SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(COUNT(*) AS BIGINT) AS requests, COUNT(*) > 1 AS over_limit FROM events GROUP BY 1, 2""")
def request_rate(t):
    out = runs.run_update(jobs.request_rate(events(t), 1, LATE), "rate", ["user_id", "start"])
    return out.withColumn("start", text_time("start"))


@query("j6_read_volume", sql="""
WITH e AS (SELECT user_id, epoch_ms(ts) // 300000 * 300 AS s, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
w AS (SELECT user_id, unnest([s, s - 300]) AS s, k FROM e)
SELECT user_id, strftime(make_timestamp(CAST(s * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS start, CAST(SUM(k) AS BIGINT) AS rows_read FROM w GROUP BY 1, 2""")
def read_volume(t):
    src = events(t).withColumn("rows_read", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"))
    out = runs.run_update(jobs.read_volume(src, LATE), "reads", ["user_id", "start"])
    return out.withColumn("start", text_time("start"))


@query("j7_once_by_event_id", sql="SELECT event_id, event_type FROM events")
def once_by_event_id(t):
    src = events(t).select("ts", "event_id", "event_type")
    return runs.run_append(jobs.once(src.unionByName(src), "event_id", LATE).select("event_id", "event_type"), "once")


@query("j8_synonym_learning", sql="""
WITH e AS (SELECT event_type AS field_name, json_extract_string(props, '$.k') AS raw_val, ts, CAST(user_id AS VARCHAR) AS value FROM events),
g AS (SELECT field_name, raw_val, arg_min(value, (ts, value)) AS learned, CAST(COUNT(*) AS BIGINT) AS hit_count FROM e GROUP BY 1, 2)
SELECT field_name, raw_val, CASE WHEN raw_val LIKE '%7' THEN 'seven' ELSE learned END AS value, CASE WHEN raw_val LIKE '%7' THEN 'MANUAL' ELSE 'AI_GENERATED' END AS source,
  raw_val LIKE '%7' AND field_name <> 'view' AS is_verified, hit_count FROM g""")
def synonym_learning(t):
    """What events teach, and what was decided on every seventh of it, kept in one table."""
    src = events(t).select(F.col("event_type").alias("field_name"), F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("raw_val"),
                           F.col("user_id").cast("string").alias("value"), "ts")
    base = new_path(t.spark, "synonyms")
    runs.run_each(src, "synonyms", lambda batch, batch_id: learned.learn(base, batch, batch_id))
    learned.compact(t.spark, base)
    sevens = learned.read(t.spark, base).where(F.col("raw_val").endswith("7"))
    learned.decide(base, sevens.select(*learned.KEY, F.lit("seven").alias("value"), (F.col("field_name") != "view").alias("is_verified")), 0)
    return learned.read(t.spark, base)


@query("j9_status_propagation", sql="""
WITH e AS (SELECT user_id % 40 AS log_id, arg_max('S' || event_type, (ts, event_id)) AS status FROM events WHERE event_type <> 'signup' GROUP BY 1)
SELECT c_custkey AS log_id, COALESCE(e.status, 'P100') AS status FROM customer LEFT JOIN e ON e.log_id = c_custkey""")
def status_propagation(t):
    src = events(t).where(F.col("event_type") != "signup").select(
        (F.col("user_id") % 40).alias("log_id"), "ts", "event_id", F.concat(F.lit("S"), "event_type").alias("status"))
    updates = runs.run_batches(src, "job-updates", jobs.latest_updates)
    # event time decides, not arrival: a late job does not undo a newer one
    last = pick_last(updates, ["log_id"], ["ts", "event_id"], ["status"])
    return t.customer.select(F.col("c_custkey").alias("log_id")).join(last, "log_id", "left").na.fill({"status": "P100"})


@query("j9_linked_updates", sql="""
WITH l AS (SELECT event_id AS log_id, user_id AS owner, ts AS created FROM events WHERE event_type = 'signup'),
u AS (SELECT user_id AS owner, ts, event_id, 'S' || event_type AS status FROM events WHERE event_type <> 'signup'),
w AS (SELECT least((SELECT MAX(created) FROM l), (SELECT MAX(ts) FROM u)) - INTERVAL 2 DAY AS mark),
j AS (SELECT log_id, created, u.event_id, status, row_number() OVER (PARTITION BY log_id ORDER BY ts DESC, event_id DESC) AS rn FROM l LEFT JOIN u ON l.owner = u.owner AND ts >= created AND ts <= created + INTERVAL 1 DAY)
SELECT log_id, event_id, COALESCE(status, 'P100') AS status FROM j, w WHERE rn = 1 AND (event_id IS NOT NULL OR created + INTERVAL 1 DAY < mark)""")
def linked_updates(t):
    """Two streams of one table: each log with the last update of its owner within a day, or none once none can come."""
    logs = events(t).where(F.col("event_type") == "signup").select(F.col("event_id").alias("log_id"), F.col("user_id").alias("owner"), F.col("ts").alias("created"))
    updates = events(t).where(F.col("event_type") != "signup").select(F.col("user_id").alias("owner"), "ts", "event_id", F.concat(F.lit("S"), "event_type").alias("status"))
    pairs = runs.run_append(jobs.linked_updates(logs, updates, "1 day", "2 days"), "linked-updates")
    last = pick_last(pairs, ["log_id"], ["ts", "event_id"], ["event_id", "status"])
    return last.na.fill({"status": "P100"})
