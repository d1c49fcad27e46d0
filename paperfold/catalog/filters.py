"""B: projections, filters and predicates over whole tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperfold.catalog.registry import query
from paperfold.functions import files
from paperfold.functions import status as st
from paperfold.functions.numbers import half_up
from paperfold.operators.calculate import assign_when
from paperfold.operators import filters as flt

# DuckDB text of the derived tables used throughout.
SQL_LOGS = """logs AS (SELECT o_orderkey AS log_id, o_custkey AS user_id, CAST(o_custkey % 25 AS INTEGER) AS model_id,
  CASE o_orderstatus WHEN 'F' THEN 'S100' WHEN 'O' THEN 'P300' WHEN 'P' THEN 'E100' END AS status,
  o_orderdate AS created_at, o_totalprice AS amount, o_orderpriority AS priority FROM orders)"""


@query("b1_metadata_projection", sql="SELECT doc_id, lang, source, n_chars FROM documents")
def metadata_projection(t):
    return t.documents.select("doc_id", "lang", "source", "n_chars")


@query("b2_equality_filters", sql=f"WITH {SQL_LOGS} SELECT log_id, user_id, model_id, status FROM logs WHERE model_id = 7 AND status = 'S100'")
def equality_filters(t):
    out = flt.where_equal(t.logs(), model_id=7, user_id=None, status="S100")
    return out.select("log_id", "user_id", "model_id", "status")


@query("b3_missing_or_equals", sql="""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 3 = 1 THEN 'extraction_log' ELSE 'extraction_job' END END AS type FROM orders)
SELECT o_orderkey, type FROM t WHERE type IS NULL OR type = 'extraction_log'""")
def missing_or_equals(t):
    k = F.col("o_orderkey") % 3
    src = t.orders.select("o_orderkey", F.when(k == 1, "extraction_log").when(k == 2, "extraction_job").alias("type"))
    return src.where(flt.missing_or(F.col("type"), "extraction_log"))


@query("b4_time_range", sql="""
SELECT event_id, user_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00'""")
def time_range(t):
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.events.where(
        (F.col("ts") >= ntz("2024-01-05 00:00:00")) & (F.col("ts") <= ntz("2024-01-12 12:00:00"))
    ).select("event_id", "user_id", "event_type")


@query("b5_relative_buckets", sql="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) = DATE '1998-08-01' AS today,
  CAST(o_orderdate AS DATE) BETWEEN DATE '1998-07-25' AND DATE '1998-08-01' AS week,
  CAST(o_orderdate AS DATE) BETWEEN DATE '1998-07-01' AND DATE '1998-08-01' AS month FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-07-01' AND DATE '1998-08-01'""")
def relative_buckets(t):
    as_of = F.lit("1998-08-01").cast("date")
    d = F.col("o_orderdate")
    return t.orders.where(flt.in_bucket(d, "month", as_of)).select(
        "o_orderkey", *[flt.in_bucket(d, b, as_of).alias(b) for b in ("today", "week", "month")])


@query("b6_substring_search", sql="""
SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') OR contains(lower(p_brand), 'red')""")
def substring_search(t):
    return flt.search(t.part, ["p_name", "p_type", "p_brand"], "RED").select("p_partkey", "p_name", "p_type")


@query("b7_metadata_filter", sql="SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '42'")
def metadata_filter(t):
    return t.events.where(
        F.try_variant_get(F.try_parse_json("props"), "$.k", "string") == "42").select("event_id", "props")


@query("b8_status_classes", sql=f"""WITH {SQL_LOGS}, m AS (SELECT log_id, CASE WHEN log_id % 7 = 0 THEN 'E300' WHEN log_id % 7 = 1 THEN 'P500' ELSE status END AS status FROM logs)
SELECT log_id, status, status IN ('S100', 'P500') AS success, status IN ('E100', 'E300') AS error,
 status = 'P300' AS processing, status = 'E300' AS cancelled FROM m""")
def status_classes(t):
    k, s = F.col("log_id") % 7, F.col("status")
    src = t.logs().select("log_id", F.when(k == 0, st.CANCELLED).when(k == 1, st.PREVIEW_READY).otherwise(s).alias("status"))
    return src.select("log_id", "status", st.is_success(s).alias("success"), st.is_error(s).alias("error"),
                      st.is_processing(s).alias("processing"), st.is_cancelled(s).alias("cancelled"))


@query("b9_scoped_audit", sql="""
WITH a AS (SELECT event_id, event_type, user_id, CAST(user_id % 25 AS BIGINT) AS resource_id,
   CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 AS detail_model,
   CASE user_id % 3 WHEN 0 THEN 'default' WHEN 2 THEN 't' || CAST(user_id % 5 AS VARCHAR) END AS tenant_id FROM events),
mine AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
SELECT event_id, event_type, tenant_id, CASE event_type WHEN 'view' THEN resource_id ELSE detail_model END AS model_id FROM a
WHERE (tenant_id IS NULL OR tenant_id = 'default' OR tenant_id = 't1')
  AND ((event_type = 'view' AND resource_id IN (SELECT n_nationkey FROM mine))
    OR (event_type = 'purchase' AND detail_model IN (SELECT n_nationkey FROM mine)))""")
def scoped_audit(t):
    u = F.col("user_id")
    tenant = F.when(u % 3 == 0, "default").when(u % 3 == 2, F.concat(F.lit("t"), (u % 5).cast("string")))
    detail = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") % 25
    model = F.when(F.col("event_type") == "view", u % 25).when(F.col("event_type") == "purchase", detail)
    audit = t.events.select("event_id", "event_type", tenant.alias("tenant_id"), model.alias("model_id"))
    mine = t.nation.where(F.col("n_regionkey") == 1).select(F.col("n_nationkey").cast("bigint").alias("model_id"))
    visible = flt.missing_or(F.col("tenant_id"), "t1") | (F.col("tenant_id") == "default")
    return audit.where(visible).join(mine, "model_id", "left_semi").select(
        "event_id", "event_type", "tenant_id", "model_id")


@query("b10_result_query", sql=f"""WITH {SQL_LOGS}
SELECT log_id, model_id, status, strftime(created_at, '%Y-%m-%d') AS day FROM logs
WHERE model_id = 3 AND status = 'P300' AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1997-12-31'
 AND contains(lower(priority), 'high')""")
def result_query(t):
    out = flt.where_equal(t.logs(), model_id=3, status="P300")
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    out = out.where((F.col("created_at") >= ntz("1996-01-01")) & (F.col("created_at") <= ntz("1997-12-31")))
    return flt.search(out, ["priority"], "High").select(
        "log_id", "model_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("b11_page_focus", sql="""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS content, CAST(COUNT(*) AS BIGINT) AS kept
FROM l WHERE line_no IN (0, 2, 5) GROUP BY doc_id""")
def page_focus(t):
    # the chosen pages bound what one document can collect
    kept = t.lines().where(F.col("line_no").isin(0, 2, 5))
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return kept.groupBy("doc_id").agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("content"),
        F.count(F.lit(1)).alias("kept"))


@query("b12_drop_blank_rows", sql="""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'NaN' ELSE l_returnflag END AS a,
  CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE l_linestatus END AS b FROM lineitem)
SELECT * FROM t WHERE l_partkey % 4 = 3 OR l_suppkey % 3 = 2""")
def drop_blank_rows(t):
    k, s = F.col("l_partkey") % 4, F.col("l_suppkey") % 3
    a = F.when(k == 1, " ").when(k == 2, "NaN").when(k == 3, F.col("l_returnflag"))
    b = F.when(s == 1, "").when(s == 2, F.col("l_linestatus"))
    src = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", a.alias("a"), b.alias("b"))
    return src.where(flt.any_filled(["a", "b"]))


@query("b13_drop_empty_columns", sql="SELECT c_custkey, c_name, c_mktsegment FROM customer")
def drop_empty_columns(t):
    src = t.customer.select("c_custkey", "c_name", F.lit(" ").alias("blank"), "c_mktsegment",
                            F.when(F.col("c_custkey") < 0, "x").alias("gone"))
    return flt.drop_empty_columns(src)


@query("b14_confidence_filter", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount * 10 < 0.5 THEN 'low_confidence' WHEN l_tax = 0 THEN 'empty' END AS drop_reason FROM lineitem""")
def confidence_filter(t):
    out = flt.with_drop_reason(t.lineitem, {
        "low_confidence": F.col("l_discount") * 10 < 0.5, "empty": F.col("l_tax") == 0})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "drop_reason")


@query("b15_category_lists", sql="""
SELECT event_id, event_type, CASE WHEN event_type NOT IN ('view', 'click') THEN 'category_not_allowed' END AS allow_reason,
 CASE WHEN event_type IN ('error') THEN 'category_excluded' END AS deny_reason FROM events""")
def category_lists(t):
    c = F.col("event_type")
    out = flt.with_drop_reason(t.events, flt.category_reasons(c, allow=["View", "CLICK"], deny=["view"]), "allow_reason")
    out = flt.with_drop_reason(out, flt.category_reasons(c, deny=["Error"]), "deny_reason")
    return out.select("event_id", "event_type", "allow_reason", "deny_reason")


@query("b16_identity_gate", sql="""
WITH p AS (SELECT a.vec_id AS baseline_id, b.vec_id AS candidate_id, a.label = b.label AS same_label,
  list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id // 2 = b.vec_id // 2 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
SELECT baseline_id, candidate_id, floor(sim * 1e6 + 0.5) / 1e6 AS similarity,
  CASE WHEN sim >= 0.2 THEN 'identical' WHEN same_label THEN 'no_differences' ELSE 'compare' END AS gate FROM p""")
def identity_gate(t):
    vec = t.embeddings.withColumn("pair", F.floor(F.col("vec_id") / 2))
    base = vec.where(F.col("vec_id") % 2 == 0).select("pair", F.col("vec_id").alias("baseline_id"),
                                                     F.col("embedding").alias("a"), F.col("label").alias("la"))
    cand = vec.where(F.col("vec_id") % 2 == 1).select("pair", F.col("vec_id").alias("candidate_id"),
                                                     F.col("embedding").alias("b"), F.col("label").alias("lb"))
    out = base.join(cand, "pair").withColumn("sim", flt.cosine(F.col("a"), F.col("b")))
    gate = F.when(F.col("sim") >= 0.2, "identical").when(F.col("la") == F.col("lb"), "no_differences").otherwise("compare")
    return out.select("baseline_id", "candidate_id", half_up(F.col("sim"), 6).alias("similarity"), gate.alias("gate"))


@query("b17_public_columns", sql="SELECT s_suppkey, s_name FROM supplier")
def public_columns(t):
    return flt.public_columns(t.supplier.select(
        "s_suppkey", "s_name", F.col("s_acctbal").alias("_balance"), F.col("s_nationkey").alias("confidence")))


@query("b18_upload_allow_list", sql=r"""
WITH f AS (SELECT page_id, page_id // 25 AS batch, CASE page_id % 11 WHEN 0 THEN '' ELSE string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] ||
   CASE page_id % 9 WHEN 0 THEN '.exe' WHEN 1 THEN '.XLSX' ELSE '.pdf' END END AS name, length(html) AS size FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY page_id) AS pos FROM f
  WHERE name <> '' AND size > 0 AND lower(regexp_extract(name, '\.[^./?#]+$')) IN ('.pdf', '.xlsx'))
SELECT page_id, batch, name, pos, CASE WHEN pos > 20 THEN 'too many files' END AS reject_reason FROM k""")
def upload_allow_list(t):
    k = F.col("page_id") % 9
    tail = F.when(k == 0, ".exe").when(k == 1, ".XLSX").otherwise(".pdf")
    name = F.when(F.col("page_id") % 11 == 0, "").otherwise(F.concat(files.file_name(F.col("url")), tail))
    src = t.pages.select("page_id", F.floor(F.col("page_id") / 25).alias("batch"), name.alias("name"),
                         F.length("html").alias("size"))
    ok = (F.col("name") != "") & (F.col("size") > 0) & files.extension(F.col("name")).isin(*files.ALLOWED_EXTENSIONS)
    placed = src.where(ok).withColumn("pos", F.row_number().over(Window.partitionBy("batch").orderBy("page_id")))
    return placed.select("page_id", "batch", "name", "pos", F.when(F.col("pos") > 20, "too many files").alias("reject_reason"))


@query("b19_worth_matching", sql=r"""
WITH v AS (SELECT p_partkey, unnest([p_name, CAST(p_size AS VARCHAR), '1,2' || CAST(p_size AS VARCHAR), substr(p_type, 1, p_size % 3)]) AS value FROM part)
SELECT p_partkey, value FROM v WHERE length(value) >= 2 AND NOT regexp_matches(replace(value, ',', ''), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$')""")
def worth_matching(t):
    size = F.col("p_size").cast("string")
    vals = F.array("p_name", size, F.concat(F.lit("1,2"), size), F.substr(F.col("p_type"), F.lit(1), F.col("p_size") % 3))
    return t.part.select("p_partkey", F.explode(vals).alias("value")).where(flt.worth_matching(F.col("value")))


@query("b20_path_lookup", sql="""
SELECT event_id, json_extract_string(props, '$.k') AS direct, event_type AS unwrapped, CAST(user_id AS VARCHAR) AS in_list FROM events""")
def path_lookup(t):
    doc = F.to_json(F.struct(
        F.col("props").alias("raw"),
        F.struct(F.struct(F.col("event_type").alias("value"), F.lit(0.9).alias("confidence")).alias("kind")).alias("a"),
        F.array(F.struct(F.struct(F.col("user_id").alias("value")).alias("u"))).alias("rows")))
    src = t.events.select("event_id", "props", doc.alias("doc"))
    return src.select("event_id", flt.json_value(F.col("props"), "k").alias("direct"),
                      flt.json_value(F.col("doc"), "a.kind").alias("unwrapped"),
                      flt.json_value(F.col("doc"), "rows[0].u").alias("in_list"))


@query("b21_conditional_assign", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN l_quantity + 50 ELSE l_quantity END AS l_quantity,
  CASE WHEN l_partkey % 5 <> 0 THEN l_suppkey // (l_partkey % 5) ELSE -1 END AS ratio FROM lineitem""")
def conditional_assign(t):
    out = t.lineitem.withColumn("ratio", F.lit(-1).cast("bigint"))
    out = assign_when(out, "l_quantity", "l_quantity + 50", "l_returnflag = 'R'")
    # dividing by zero fails, so the field keeps its value
    out = assign_when(out, "ratio", "cast(floor(try_divide(l_suppkey, l_partkey % 5)) as bigint)")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "ratio")


@query("b22_published_models", sql="""
WITH m AS (SELECT n_nationkey, n_name, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'PUBLISHED' WHEN 2 THEN 'DRAFT' ELSE 'ARCHIVED' END AS status,
  CASE WHEN n_nationkey % 3 > 0 THEN 'v2.0.0' END AS version, CASE WHEN n_nationkey % 5 = 0 THEN false END AS is_active FROM nation)
SELECT n_nationkey, n_name, COALESCE(status, 'PUBLISHED') AS status, COALESCE(version, 'v1.0.0') AS version FROM m
WHERE COALESCE(status, 'PUBLISHED') = 'PUBLISHED' AND COALESCE(is_active, true)""")
def published_models(t):
    k = F.col("n_nationkey")
    src = t.nation.select(
        k, "n_name",
        F.when(k % 4 == 1, "PUBLISHED").when(k % 4 == 2, "DRAFT").when(k % 4 == 3, "ARCHIVED").alias("status"),
        F.when(k % 3 > 0, "v2.0.0").alias("version"), F.when(k % 5 == 0, False).alias("is_active"))
    return src.na.fill({"status": "PUBLISHED", "version": "v1.0.0", "is_active": True}).where(
        (F.col("status") == "PUBLISHED") & F.col("is_active")).drop("is_active")


@query("b23_confirmation", sql=f"""WITH {SQL_LOGS},
j AS (SELECT log_id, CASE WHEN log_id % 5 = 0 THEN 'P500' ELSE status END AS status, priority AS preview FROM logs),
e AS (SELECT o_orderkey AS log_id, 'edited ' || CAST(o_custkey AS VARCHAR) AS edited FROM orders WHERE o_custkey % 10 = 0)
SELECT j.log_id, CASE WHEN status IN ('P500', 'S100') THEN COALESCE(edited, preview) END AS confirmed,
 CASE WHEN status NOT IN ('P500', 'S100') THEN 'not confirmable: ' || status END AS reject_reason
FROM j LEFT JOIN e ON j.log_id = e.log_id""")
def confirmation(t):
    s = F.col("status")
    jobs = t.logs().select("log_id", F.when(F.col("log_id") % 5 == 0, st.PREVIEW_READY).otherwise(s).alias("status"),
                           F.col("priority").alias("preview"))
    edits = t.orders.where(F.col("o_custkey") % 10 == 0).select(
        F.col("o_orderkey").alias("log_id"), F.concat(F.lit("edited "), F.col("o_custkey").cast("string")).alias("edited"))
    ok = s.isin(st.PREVIEW_READY, st.SUCCESS)
    return jobs.join(edits, "log_id", "left").select(
        "log_id", F.when(ok, F.coalesce("edited", "preview")).alias("confirmed"),
        F.when(~ok, F.concat(F.lit("not confirmable: "), s)).alias("reject_reason"))
