"""A: scans and sinks on data derived from the given tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.catalog.filters import SQL_LOGS
from paperfold.catalog.registry import query
from paperfold.functions.boxes import box_text
from paperfold.functions.files import column_letters
from paperfold.plans.segments import numbered_all
from paperfold.sources import readers as rd
from paperfold.sources import sinks as sk
from paperfold.sources.shared import new_path


@query("a1_csv_scan", sql="""
SELECT CASE WHEN n_nationkey % 3 = 1 THEN 'cp949' WHEN n_nationkey % 3 = 2 THEN 'latin-1' ELSE 'utf-8' END AS encoding, n_nationkey AS id,
 n_name || CASE n_nationkey % 3 WHEN 0 THEN ' 부산, 인천' WHEN 1 THEN ' 서울' ELSE ' café ¿' || chr(255) END AS name FROM nation""")
def csv_scan(t):
    k = F.col("n_nationkey") % 3
    tail = F.when(k == 0, " 부산, 인천").when(k == 1, " 서울").otherwise(" café ¿ÿ")
    rows = t.nation.select("n_nationkey", F.concat("n_name", tail).alias("name"))
    base = new_path(t.spark, "csv")
    with rd.lenient_charsets(t.spark):
        for i, enc in enumerate(rd.ENCODINGS):
            rows.where(F.col("n_nationkey") % 3 == i).write.option("encoding", enc).csv(f"{base}/part={i}")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    return rd.read_encoded_csv(t.spark, f"{base}/*", schema)


@query("a2_multi_sheet_union", sql="""
WITH s AS (SELECT 1 AS sheet_no, 'region' AS sheet_name, r_regionkey AS id, r_name AS name, NULL::INTEGER AS parent FROM region
 UNION ALL SELECT 2, 'nation', n_nationkey, n_name, n_regionkey FROM nation)
SELECT sheet_name, id, name, parent, CAST(row_number() OVER (PARTITION BY sheet_no ORDER BY id) AS BIGINT) AS local_row_id,
 CAST(row_number() OVER (ORDER BY sheet_no, id) AS BIGINT) AS row_id FROM s""")
def multi_sheet_union(t):
    a = t.region.select(F.lit(1).alias("sheet_no"), F.lit("region").alias("sheet_name"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    b = t.nation.select(F.lit(2).alias("sheet_no"), F.lit("nation").alias("sheet_name"), F.col("n_nationkey").alias("id"),
                        F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    rows = a.unionByName(b, allowMissingColumns=True)
    rows = numbered_all(rows, ["sheet_no", "id"], "row_id")
    firsts = rows.groupBy("sheet_no").agg(F.min("row_id").alias("first"))
    rows = rows.join(firsts, "sheet_no").withColumn("local_row_id", F.col("row_id") - F.col("first") + 1)
    return rows.select("sheet_name", "id", "name", "parent", "local_row_id", "row_id")


@query("a3_letter_columns", sql='SELECT s_suppkey AS "A", s_name AS "B", s_nationkey AS "C", s_acctbal AS "D" FROM supplier')
def letter_columns(t):
    return t.supplier.toDF(*column_letters(len(t.supplier.columns)))


@query("a4_ocr_scan", sql="""
SELECT o_orderkey AS doc_id, p.n AS page_number, CASE WHEN p.n = 1 THEN o_orderpriority ELSE o_orderstatus END AS content, CAST(0 AS INTEGER) AS tables
FROM orders, (VALUES (1), (2)) p(n)""")
def ocr_scan(t):
    camel = F.struct(F.lit(1).alias("pageNumber"), F.lit(None).cast("int").alias("page_number"), F.col("o_orderpriority").alias("content"))
    snake = F.struct(F.lit(None).cast("int").alias("pageNumber"), F.lit(2).alias("page_number"), F.col("o_orderstatus").alias("content"))
    raw = t.orders.select("o_orderkey", F.to_json(F.struct(F.array(camel, snake).alias("pages"))).alias("body"))
    schema = "pages array<struct<pageNumber:int,page_number:int,content:string>>, tables array<struct<row_count:int>>"
    docs = raw.select(F.col("o_orderkey").alias("doc_id"), F.from_json("body", schema).alias("d"))
    page = F.col("p")
    return docs.select("doc_id", F.explode_outer("d.pages").alias("p"),
                       F.size(F.coalesce("d.tables", F.array().cast("array<struct<row_count:int>>"))).alias("tables")).select(
        "doc_id", rd.either_case(page, "page_number", "pageNumber").alias("page_number"), page["content"].alias("content"), "tables")


@query("a5_key_values", sql="""
WITH p AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_type END AS key, json_extract_string(props, '$.k') AS value, user_id AS u FROM events)
SELECT event_id, key, value, CASE WHEN u % 2 = 0 THEN CAST(u * 1000 AS VARCHAR) || ',1000,' || CAST((u + 5) * 1000 AS VARCHAR) || ',3000'
  ELSE '0,0,' || CAST(u * 1000 AS VARCHAR) || ',2000' END AS bbox FROM p WHERE key IS NOT NULL""")
def key_values(t):
    u = F.col("user_id").cast("double")
    one, three, zero, two = F.lit(1.0), F.lit(3.0), F.lit(0.0), F.lit(2.0)
    value_region = F.when(F.col("user_id") % 2 == 0, F.array(u + 5, one, u, one, u, three, u + 5, three))
    key_region = F.array(zero, zero, u, zero, u, two, zero, two)
    pairs = t.events.select("event_id", F.when(F.col("event_id") % 7 > 0, F.col("event_type")).alias("key"),
                            F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("value"),
                            F.coalesce(value_region, key_region).alias("region"))
    return pairs.where(F.col("key").isNotNull()).select(
        "event_id", "key", "value", box_text(rd.polygon_box(F.col("region"))).alias("bbox"))


@query("a6_document_fields", sql="""
SELECT o_orderkey, COALESCE(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR) END,
 strftime(o_orderdate, '%Y-%m-%d')) AS value, CASE o_custkey % 3 WHEN 0 THEN '1,2' WHEN 1 THEN '1,3' ELSE '2' END AS pages FROM orders""")
def document_fields(t):
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey") % 3
    one, two, three = F.lit(1), F.lit(2), F.lit(3)
    pages = F.when(c == 0, F.array(two, one, two)).when(c == 1, F.array(three, one)).otherwise(F.array(two, two))
    src = t.orders.select("o_orderkey", F.when(k == 0, F.col("o_orderpriority")).alias("value_string"),
                          F.when(k == 1, F.col("o_custkey")).alias("value_number"),
                          F.date_format("o_orderdate", "yyyy-MM-dd").alias("value_date"), pages.alias("pages"))
    value = F.coalesce("value_string", F.col("value_number").cast("string"), "value_date")
    return src.select("o_orderkey", value.alias("value"), F.array_join(F.array_sort(F.array_distinct("pages")), ",").alias("pages"))


@query("a7_read_through_cache", sql="""
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE length(text) END AS BIGINT) AS size, doc_id % 3 = 0 AS cached FROM documents""")
def read_through_cache(t):
    cache = t.documents.where(F.col("doc_id") % 3 == 0).select("doc_id", F.col("n_chars").alias("size"))
    return rd.through_cache(t.documents.select("doc_id", "text"), cache, "doc_id",
                            lambda todo: todo.select("doc_id", F.length("text").cast("bigint").alias("size")))


@query("a8_permissive_scan", sql="""
SELECT event_id, CASE WHEN event_id % 10 > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
 CASE WHEN event_id % 10 = 0 THEN left(props, 4) END AS quarantined FROM events""")
def permissive_scan(t):
    body = F.when(F.col("event_id") % 10 == 0, F.left("props", F.lit(4))).otherwise(F.col("props"))
    src = t.events.select("event_id", body.alias("body"))
    out = rd.parse_records(src, "body", T.StructType([T.StructField("k", T.LongType())]))
    return out.select("event_id", "k", F.col("_corrupt").alias("quarantined"))


@query("a9_upsert", sql=f"""WITH {SQL_LOGS},
old AS (SELECT log_id, status, strftime(created_at, '%Y-%m-%d') AS created_at FROM logs WHERE log_id % 3 > 0),
upd AS (SELECT log_id, 'S100' AS status, '2002-01-01' AS created_at FROM logs WHERE log_id % 2 = 0 AND log_id % 4 > 0
  UNION ALL SELECT log_id, 'E300', '2002-01-02' FROM logs WHERE log_id % 4 = 0)
SELECT COALESCE(old.log_id, upd.log_id) AS log_id, COALESCE(upd.status, old.status) AS status, COALESCE(old.created_at, upd.created_at) AS created_at
FROM old FULL JOIN upd ON old.log_id = upd.log_id""")
def upsert(t):
    logs = t.logs().select("log_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))
    even = logs.where(F.col("log_id") % 2 == 0)
    first = even.select("log_id", F.lit("S100").alias("status"), F.lit("2002-01-01").alias("created_at"), F.lit(1).alias("seq"))
    second = even.where(F.col("log_id") % 4 == 0).select("log_id", F.lit("E300").alias("status"), F.lit("2002-01-02").alias("created_at"), F.lit(2).alias("seq"))
    return sk.upsert(logs.where(F.col("log_id") % 3 > 0), first.unionByName(second), "log_id", "seq")


PARTS = ["debug_data", "extracted_data", "preview_data"]


def records(t):
    x = F.col("text")
    return t.documents.select("doc_id", x.alias("debug_data"), F.concat("source", F.lit(": "), x).alias("extracted_data"),
                              F.concat("lang", F.lit(" "), "source").alias("preview_data"))


SQL_OFFLOAD = """r AS (SELECT doc_id, text AS d, source || ': ' || text AS e, lang || ' ' || source AS p FROM documents),
s AS (SELECT *, length(d) + length(e) + length(p) > 1000 AS d_out FROM r),
u AS (SELECT *, CASE WHEN d_out THEN 0 ELSE length(d) END + length(e) + length(p) > 1000 AS e_out FROM s),
v AS (SELECT *, CASE WHEN d_out THEN 0 ELSE length(d) END + CASE WHEN e_out THEN 0 ELSE length(e) END + length(p) > 1000 AS p_out FROM u)"""


@query("a10_offload", sql=f"""WITH {SQL_OFFLOAD}
SELECT doc_id, CASE WHEN NOT d_out THEN d END AS debug_data, CASE WHEN d_out THEN CAST(doc_id AS VARCHAR) || '/debug_data' END AS debug_data_ref,
 CASE WHEN NOT e_out THEN e END AS extracted_data, CASE WHEN e_out THEN CAST(doc_id AS VARCHAR) || '/extracted_data' END AS extracted_data_ref,
 CASE WHEN NOT p_out THEN p END AS preview_data, CASE WHEN p_out THEN CAST(doc_id AS VARCHAR) || '/preview_data' END AS preview_data_ref FROM v""")
def offload(t):
    return sk.main_table(sk.offload(records(t), "doc_id", PARTS, 1000), "doc_id", PARTS)


@query("a10_payloads", sql=f"""WITH {SQL_OFFLOAD}
SELECT CAST(doc_id AS VARCHAR) || '/debug_data' AS ref, d AS payload FROM v WHERE d_out
UNION ALL SELECT CAST(doc_id AS VARCHAR) || '/extracted_data', e FROM v WHERE e_out
UNION ALL SELECT CAST(doc_id AS VARCHAR) || '/preview_data', p FROM v WHERE p_out""")
def payloads(t):
    return sk.payload_table(sk.offload(records(t), "doc_id", PARTS, 1000), "doc_id", PARTS)


@query("a11_hydrate", sql="""
SELECT doc_id, text AS debug_data, source || ': ' || text AS extracted_data, lang || ' ' || source AS preview_data FROM documents""")
def hydrate(t):
    marked = sk.offload(records(t), "doc_id", PARTS, 1000)
    return sk.hydrate(sk.main_table(marked, "doc_id", PARTS), sk.payload_table(marked, "doc_id", PARTS), PARTS)


@query("a12_attachments", sql="""
SELECT doc_id, '%PDF-' || text AS body, doc_id % 3 AS layers FROM documents""")
def attachments(t):
    one = F.base64(F.encode(F.concat(F.lit("%PDF-"), F.col("text")), "UTF-8"))
    two = F.base64(F.encode(one, "UTF-8"))
    k = F.col("doc_id") % 3
    url_safe = F.rtrim(F.replace(F.replace(one, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_")), F.lit("="))
    sent = F.when(k == 0, F.concat(F.lit("data:application/pdf;base64,"), one)).when(k == 1, url_safe).otherwise(two)
    out = rd.decode_attachment(t.documents.select("doc_id", k.alias("layers"), sent.alias("sent")), "sent", "data")
    return out.select("doc_id", F.decode("data", "UTF-8").alias("body"), "layers")


@query("a13_csv_sink", sql="""
SELECT event_id, event_type, props FROM events""")
def csv_sink(t):
    path = new_path(t.spark, "audit-csv")
    t.events.select("event_id", "event_type", "props").write.csv(path, header=True, escape='"')
    return t.spark.read.csv(path, header=True, escape='"', schema="event_id bigint, event_type string, props string")


@query("a14_outbox", sql=f"""WITH {SQL_LOGS}
SELECT '{{"event":"extraction.confirmed","log_id":' || CAST(log_id AS VARCHAR) || ',"model_id":' || CAST(model_id AS VARCHAR) || ',"status":"' || status || '"}}' AS message FROM logs WHERE status = 'S100'""")
def outbox(t):
    return sk.outbox(t.logs().where(F.col("status") == "S100"), "extraction.confirmed", ["log_id", "model_id", "status"])


@query("a15_bulk_users", sql="""
SELECT lower(c_name) || '@example.com' AS email, c_name AS name, unnest(['g' || CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS group_name
FROM customer WHERE c_custkey % 7 > 0 AND (c_custkey % 2 = 0 OR c_custkey % 5 > 0)
UNION ALL SELECT lower(c_name) || '@example.com', c_name, NULL FROM customer WHERE c_custkey % 7 > 0 AND c_custkey % 2 = 1 AND c_custkey % 5 = 0""")
def bulk_users(t):
    """Even customers come in CSV, odd ones in JSON."""
    paths = {kind: new_path(t.spark, f"users-{kind}") for kind in ("csv", "json")}
    k = F.col("c_custkey")
    email, group = F.when(k % 7 > 0, F.concat(F.lower("c_name"), F.lit("@example.com"))), F.concat(F.lit("g"), F.col("c_nationkey").cast("string"))
    rows = t.customer.select(k, email.alias("email"), F.col("c_name").alias("name"), group.alias("g"), F.col("c_mktsegment").alias("m"))
    even = k % 2 == 0
    rows.where(even).select("email", "name", F.concat("g", F.lit("; "), "m").alias("groups")).write.csv(paths["csv"], header=True)
    rows.where(~even).select("email", "name", F.when(k % 5 > 0, F.array("g", "m")).alias("groups")).write.json(paths["json"])
    return rd.read_users(t.spark, paths["csv"], "csv").unionByName(rd.read_users(t.spark, paths["json"], "jsonl"))


@query("a16_dictionary_load", sql="""
SELECT 'part' AS category, CAST(p_partkey AS VARCHAR) AS code, trim(p_name) AS name, p_brand AS brand, 'size cm' AS header,
 md5('part|' || CAST(p_partkey + 1 AS VARCHAR) || '|' || CAST(p_partkey AS VARCHAR) || '|' || p_name || '|' || p_brand || '|' || CASE WHEN p_size > 20 THEN CAST(p_size AS VARCHAR) ELSE '' END) AS row_id FROM part""")
def dictionary_load(t):
    sheet = t.part.select("p_partkey", F.concat(F.lit(" "), "p_name").alias("p_name"), "p_brand",
                          F.when(F.col("p_size") > 20, F.col("p_size")).alias("size cm"), (F.col("p_partkey") + 1).alias("row_no"))
    out = rd.load_dictionary(sheet, "part", "row_no")
    return out.select("category", "code", "name", F.col("extra")["p_brand"].alias("brand"), F.col("headers")["size_cm"].alias("header"), "row_id")
