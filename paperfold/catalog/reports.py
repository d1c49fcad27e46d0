"""D, F, G, H: aggregations, ordered picks, paging and set operations."""

from pyspark.sql import functions as F

from paperfold.catalog.filters import SQL_LOGS
from paperfold.catalog.registry import query
from paperfold.functions import status as st
from paperfold.functions.numbers import half_up
from paperfold.operators import merge, report
from paperfold.plans.pick import head_per_key, pick_first, pick_last
from paperfold.plans.segments import carry, lead, prefix_sum, ranged, row_number, segmented, total

ORD = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice"
LKEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SQL_LINES = """lines AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"""
SQL_RESULTS = """results AS (SELECT conv_id AS doc_id, turn AS chunk_index, role AS field_key,
  CASE WHEN length(text) % 5 <> 0 THEN text END AS value, (length(text) % 100) / 100 AS confidence,
  CAST(length(text) AS BIGINT) AS size FROM conversations)"""


def ntz(s):
    return F.lit(s).cast("timestamp_ntz")


@query("d1_period_kpis", sql=f"""WITH {SQL_LOGS}
SELECT CAST(COUNT(*) AS BIGINT) AS total,
 floor(COUNT(*) FILTER (status IN ('S100', 'P500')) * 1000 / COUNT(*) + 0.5) / 10 AS success_rate,
 CAST(COUNT(DISTINCT n_name) AS BIGINT) AS active_models
FROM logs LEFT JOIN nation ON model_id = n_nationkey WHERE created_at >= TIMESTAMP '1997-08-01'""")
def period_kpis(t):
    logs = t.logs().where(F.col("created_at") >= ntz("1997-08-01"))
    return report.period_kpis(logs.join(t.models(), "model_id", "left"))


@query("d2_daily_trend", sql="""
WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day),
c AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS total, COUNT(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT CAST(d.day AS VARCHAR) AS day, CAST(COALESCE(total, 0) AS BIGINT) AS total, CAST(COALESCE(errors, 0) AS BIGINT) AS errors
FROM d LEFT JOIN c ON d.day = c.day""")
def daily_trend(t):
    out = report.daily_trend(t.events, F.col("ts"), "2024-01-01", "2024-02-05",
                             total=F.lit(True), errors=F.col("event_type") == "error")
    return out.withColumn("day", F.col("day").cast("string"))


@query("d3_model_usage", sql=f"""WITH {SQL_LOGS}
SELECT COALESCE(n_name, 'Unknown') AS model_name, CAST(COUNT(*) AS BIGINT) AS uses FROM logs LEFT JOIN nation ON model_id = n_nationkey AND n_nationkey % 6 > 0 GROUP BY 1""")
def model_usage(t):
    # counted per id before the name is looked up: the join sees one row per model
    per_id = report.usage(t.logs(), "model_id")
    names = t.models().where(F.col("model_id") % 6 > 0)
    named = per_id.join(names, "model_id", "left").withColumn("model_name", F.coalesce("model_name", F.lit("Unknown")))
    return named.groupBy("model_name").agg(F.sum("uses").alias("uses")).orderBy(F.desc("uses"), "model_name")


@query("d4_status_tiles", sql=f"""WITH {SQL_LOGS}
SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(COUNT(*) FILTER (status = 'S100') AS BIGINT) AS success,
 CAST(COUNT(*) FILTER (status = 'P300') AS BIGINT) AS processing, CAST(COUNT(*) FILTER (status = 'E100') AS BIGINT) AS error,
 CAST(COUNT(*) FILTER (CAST(created_at AS DATE) = DATE '1998-08-01') AS BIGINT) AS today FROM logs""")
def status_tiles(t):
    return report.status_tiles(t.logs(), "1998-08-01")


@query("d5_mean_confidence", sql="""
SELECT l_orderkey, floor(CAST(SUM(CAST(l_discount AS DECIMAL(6,2))) AS DOUBLE) / COUNT(*) * 10000 + 0.5) / 10000 AS confidence,
 CAST(COUNT(*) AS BIGINT) AS cells FROM lineitem WHERE l_tax > 0 GROUP BY l_orderkey""")
def mean_confidence(t):
    c = F.when(F.col("l_tax") > 0, F.col("l_discount").cast("decimal(6,2)"))
    out = t.lineitem.where(F.col("l_tax") > 0).groupBy("l_orderkey").agg(
        F.sum(c).cast("double").alias("s"), F.count(c).alias("cells"))
    return out.select("l_orderkey", half_up(F.col("s") / F.col("cells"), 4).alias("confidence"), "cells")


@query("d6_token_cost", sql="""
WITH c AS (SELECT CAST(conv_id % 5 AS BIGINT) AS model_id, CAST(conv_id % 7 AS BIGINT) AS user_id, role, length(text) // 4 AS tokens FROM conversations)
SELECT model_id, user_id, CAST(COALESCE(SUM(tokens) FILTER (role <> 'assistant'), 0) AS BIGINT) AS prompt_tokens,
 CAST(COALESCE(SUM(tokens) FILTER (role = 'assistant'), 0) AS BIGINT) AS completion_tokens, CAST(SUM(tokens) AS BIGINT) AS total_tokens,
 floor((COALESCE(SUM(tokens) FILTER (role <> 'assistant'), 0)::DOUBLE / 1000 * 0.005::DOUBLE + COALESCE(SUM(tokens) FILTER (role = 'assistant'), 0)::DOUBLE / 1000 * 0.015::DOUBLE) * 1000000 + 0.5) / 1000000 AS cost
FROM c GROUP BY ROLLUP (model_id, user_id)""")
def token_cost(t):
    tokens, bot = F.floor(F.length("text") / 4), F.col("role") == "assistant"
    src = t.conversations.select((F.col("conv_id") % 5).alias("model_id"), (F.col("conv_id") % 7).alias("user_id"),
                                 F.when(~bot, tokens).otherwise(0).alias("p"), F.when(bot, tokens).otherwise(0).alias("c"))
    out = src.rollup("model_id", "user_id").agg(F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"))
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn(
        "cost", report.token_cost(F.col("prompt_tokens"), F.col("completion_tokens")))


@query("d7_best_confidence_merge", sql=f"""WITH {SQL_RESULTS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_key
   ORDER BY value IS NULL, CASE WHEN value IS NOT NULL THEN -confidence END, chunk_index) AS rn FROM results)
SELECT doc_id, field_key, value, confidence, chunk_index FROM r WHERE rn = 1""")
def best_confidence(t):
    return merge.best_confidence(t.chunk_results())


@query("d8_first_non_null_merge", sql=f"""WITH {SQL_RESULTS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_key ORDER BY value IS NULL, chunk_index) AS rn FROM results)
SELECT doc_id, field_key, value, chunk_index FROM r WHERE rn = 1""")
def first_non_null(t):
    k = F.col("field_key")
    spelled = t.chunk_results().withColumn("field_key", F.when(F.col("chunk_index") % 2 == 0, F.upper(k)).otherwise(
        F.concat(F.left(k, F.lit(2)), F.lit("_"), F.substr(k, F.lit(3)))))
    keys = t.conversations.select(F.col("role").alias("field_key")).distinct()
    return merge.first_non_null(merge.canonical_keys(spelled, "field_key", keys))


@query("d8_row_append", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber // 3 AS page,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber // 3, {ORD}) AS BIGINT) AS pos FROM lineitem""")
def row_append(t):
    rows = t.lineitem.withColumn("page", F.floor(F.col("l_linenumber") / 3).cast("int"))
    out = merge.append_rows(rows.select("l_orderkey", "page", *t.ROW_ORDER), "l_orderkey", "page", t.ROW_ORDER)
    return out.select(*LKEY, "page", "pos")


@query("d9_row_dedup", sql="""
WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_linenumber // 3 AS chunk, l_linenumber AS pos FROM lineitem
 UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_linenumber // 3 + 1, l_linenumber FROM lineitem WHERE l_partkey % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_quantity ORDER BY chunk, pos) AS rn FROM c)
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, CAST(chunk AS BIGINT) AS source_chunk, pos FROM r WHERE rn = 1""")
def row_dedup(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                             F.floor(F.col("l_linenumber") / 3).alias("source_chunk"), F.col("l_linenumber").alias("pos"))
    copies = rows.where(F.col("l_partkey") % 3 == 0).withColumn("source_chunk", F.col("source_chunk") + 1)
    return merge.dedup_rows(rows.unionByName(copies), ["l_orderkey"], ["l_partkey", "l_suppkey", "l_quantity"],
                            ["source_chunk", "pos"])


@query("d10_duplicate_flag", sql=f"""
WITH k AS (SELECT *, lower(trim(COALESCE(NULLIF(CASE WHEN l_suppkey % 2 = 0 THEN l_returnflag END, ''), ' ' || l_returnflag || ' '))) || '|' || lower(l_linestatus) AS composite FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, composite,
  row_number() OVER (PARTITION BY l_orderkey, composite ORDER BY {ORD}) > 1 AS is_duplicate FROM k""")
def duplicate_flag(t):
    code = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_returnflag"))
    raw = F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" "))
    part = lambda c: F.lower(F.trim(c))
    rows = t.lineitem.withColumn("composite", F.concat_ws(
        "|", part(F.coalesce(F.nullif(code, F.lit("")), raw)), part(F.col("l_linestatus"))))
    return merge.duplicate_flag(rows, ["l_orderkey", "composite"], t.ROW_ORDER).select(
        *LKEY, "composite", "is_duplicate")


@query("d11_unmapped_values", sql="""
WITH c AS (SELECT 'p_name' AS field_name, p_name AS raw_val FROM part UNION ALL SELECT 'p_type', p_type FROM part),
s AS (SELECT DISTINCT 'p_name' AS field_name, p_name AS raw_val FROM part WHERE p_partkey % 9 = 0)
SELECT DISTINCT field_name, raw_val FROM c WHERE (field_name, raw_val) NOT IN (SELECT (field_name, raw_val) FROM s)""")
def unmapped_values(t):
    cells = t.part.unpivot(["p_partkey"], ["p_name", "p_type"], "field_name", "raw_val")
    known = t.part.where(F.col("p_partkey") % 9 == 0).select(F.lit("p_name").alias("field_name"), F.col("p_name").alias("raw_val"))
    return cells.select("field_name", "raw_val").distinct().join(known.distinct(), ["field_name", "raw_val"], "left_anti")


@query("d12_grouped_totals", sql="""
SELECT l_returnflag, l_linestatus, CAST(GROUPING_ID(l_returnflag, l_linestatus) AS BIGINT) AS total_level, CAST(COUNT(*) AS BIGINT) AS row_count,
 CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS l_extendedprice_sum,
 floor(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) * 10000 + 0.5) / 10000 AS l_extendedprice_avg,
 0.0::DOUBLE AS l_shipmode_sum, 0.0::DOUBLE AS l_shipmode_avg
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def grouped_totals(t):
    rows = t.lineitem.withColumn("l_shipmode", F.lit("n/a"))
    return report.grouped_totals(rows, ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_shipmode"])


@query("d13_synonym_upsert", sql="""
WITH p AS (SELECT event_type AS field_name, json_extract_string(props, '$.k') AS raw_val, user_id FROM events),
e AS (SELECT field_name, raw_val, COUNT(*) AS hits FROM p WHERE user_id % 4 = 0 GROUP BY ALL),
n AS (SELECT field_name, raw_val, COUNT(*) AS hits FROM p WHERE user_id % 4 > 1 GROUP BY ALL)
SELECT COALESCE(e.field_name, n.field_name) AS field_name, COALESCE(e.raw_val, n.raw_val) AS raw_val,
 CAST(COALESCE(e.hits, 0) + COALESCE(n.hits, 0) AS BIGINT) AS hit_count, e.hits IS NOT NULL AS is_verified
FROM e FULL JOIN n ON e.field_name = n.field_name AND e.raw_val = n.raw_val""")
def synonym_upsert(t):
    pairs = t.events.select(F.col("event_type").alias("field_name"), "user_id",
                            F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("raw_val"))
    existing = pairs.where(F.col("user_id") % 4 == 0).groupBy("field_name", "raw_val").agg(
        F.count(F.lit(1)).alias("hit_count")).withColumn("is_verified", F.lit(True))
    return report.upsert_hits(existing, pairs.where(F.col("user_id") % 4 > 1), ["field_name", "raw_val"])


@query("d14_standard_codes", sql="""
SELECT DISTINCT 'p_brand' AS field_name, p_type AS standard, p_brand AS raw_val,
 CAST(COUNT(DISTINCT p_brand) OVER (PARTITION BY p_type) AS BIGINT) AS variants FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size % 2 = 0)""")
def standard_codes(t):
    # the reverse map stays a table of pairs: one standard may own any number of variants
    pairs = t.part.where(F.col("p_size") % 2 == 0).select(
        F.lit("p_brand").alias("field_name"), F.col("p_type").alias("standard"), F.col("p_brand").alias("raw_val")).distinct()
    counts = pairs.groupBy("standard").agg(F.count(F.lit(1)).alias("variants"))
    return pairs.join(counts, "standard")


@query("d15_pivot_export", sql=f"""
WITH r AS (SELECT l_orderkey, l_returnflag || '_' || l_linestatus AS name, CAST(l_quantity AS BIGINT) AS q,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY {ORD}) AS rn FROM lineitem)
SELECT o.o_orderkey AS order_id, o.o_orderpriority AS priority, MAX(q) FILTER (name = 'A_F') AS af, MAX(q) FILTER (name = 'N_O') AS no, MAX(q) FILTER (name = 'R_F') AS rf
FROM orders o LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON r.l_orderkey = o.o_orderkey GROUP BY ALL""")
def pivot_export(t):
    rows = t.lineitem.withColumns({"name": F.concat_ws("_", "l_returnflag", "l_linestatus"), "q": F.col("l_quantity").cast("bigint")})
    wide = report.pivot_export(rows, ["l_orderkey"], "name", ["A_F", "N_O", "R_F"], "q", t.ROW_ORDER)
    return t.orders.join(wide, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"),
        F.col("A_F").alias("af"), F.col("N_O").alias("no"), F.col("R_F").alias("rf"))


@query("d16_repeat_blocks", sql=f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORD}) AS n FROM lineitem)
SELECT l_orderkey, layout_row, {', '.join(f"MAX(l_partkey) FILTER (b = {b}) AS l_partkey_{b}, MAX(l_quantity) FILTER (b = {b}) AS l_quantity_{b}" for b in (1, 2, 3))}
FROM (SELECT *, (n - 1) % 3 + 1 AS b, (n - 1) // 3 AS layout_row FROM r) GROUP BY l_orderkey, layout_row""")
def repeat_blocks(t):
    return report.repeat_blocks(t.lineitem, ["l_orderkey"], t.ROW_ORDER, 3, ["l_partkey", "l_quantity"])


@query("d17_table_size", sql="""
WITH c AS (SELECT l_orderkey, l_linenumber AS r, l_partkey % 5 AS c, l_suppkey % 3 + 1 AS rs, l_partkey % 2 + 1 AS cs, CASE WHEN l_orderkey % 3 = 0 THEN 9 ELSE 0 END AS d FROM lineitem)
SELECT l_orderkey, CAST(COALESCE(NULLIF(MAX(d), 0), MAX(r + rs)) AS BIGINT) AS row_count, CAST(MAX(c + cs) AS BIGINT) AS col_count FROM c GROUP BY l_orderkey""")
def table_size(t):
    cells = t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").alias("row_index"), (F.col("l_partkey") % 5).alias("col_index"),
        (F.col("l_suppkey") % 3 + 1).alias("row_span"), (F.col("l_partkey") % 2 + 1).alias("col_span"),
        F.when(F.col("l_orderkey") % 3 == 0, 9).otherwise(0).alias("declared_rows"), F.lit(0).alias("declared_cols"))
    return report.table_size(cells, ["l_orderkey"])


@query("d18_field_coverage", sql="""
WITH c AS (SELECT o_orderkey, unnest(['status', 'priority', 'total', 'ghost']) AS field_key,
  unnest([CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, CAST(o_custkey AS VARCHAR), NULL]) AS v FROM orders)
SELECT o_orderkey, CAST(COUNT(*) FILTER (v IS NOT NULL) AS BIGINT) AS found, CAST(COUNT(*) FILTER (v IS NULL) AS BIGINT) AS missing,
 CAST(COUNT(*) FILTER (v <> '') AS BIGINT) AS filled FROM c GROUP BY o_orderkey""")
def field_coverage(t):
    cells = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"),
                            F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("priority"),
                            F.col("o_custkey").cast("string").alias("total"), F.lit(None).cast("string").alias("ghost"))
    fields = ["status", "priority", "total", "ghost"]
    count = lambda cond: sum((cond(F.col(f)).cast("bigint") for f in fields), F.lit(0).cast("bigint"))
    return cells.select("o_orderkey", count(lambda c: c.isNotNull()).alias("found"),
                        count(lambda c: c.isNull()).alias("missing"),
                        count(lambda c: F.coalesce(c != "", F.lit(False))).alias("filled"))


@query("d19_chunk_accounting", sql=f"""WITH {SQL_RESULTS}
SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS total_chunks, CAST(COUNT(value) AS BIGINT) AS successful_chunks,
 floor(COUNT(value) * 1000 / COUNT(*) + 0.5) / 1000 AS success_ratio FROM results GROUP BY doc_id""")
def chunk_accounting(t):
    return merge.chunk_accounting(t.chunk_results().withColumn("success", F.col("value").isNotNull()))


@query("d19_chunk_errors", sql=f"""WITH {SQL_RESULTS}
SELECT doc_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN 'failed: ' || field_key ELSE 'Unknown Error' END AS error FROM results WHERE value IS NULL""")
def chunk_errors(t):
    return merge.chunk_errors(failing_chunks(t))


@query("d19_field_sources", sql=f"""WITH {SQL_RESULTS},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_key ORDER BY confidence DESC, chunk_index) AS rn FROM results WHERE value IS NOT NULL)
SELECT doc_id, field_key, chunk_index FROM r WHERE rn = 1""")
def field_sources(t):
    return merge.field_sources(failing_chunks(t))


def failing_chunks(t):
    error = F.when(F.col("value").isNull() & (F.col("chunk_index") % 2 == 0), F.concat(F.lit("failed: "), "field_key"))
    return t.chunk_results().withColumns({"success": F.col("value").isNotNull(), "error": error})


@query("d20_grid_waste", sql="""
WITH l AS (SELECT page_id, unnest(range(len(a))) AS row_no, unnest(a) AS line FROM (SELECT page_id, string_split(html, '<') AS a FROM pages)),
c AS (SELECT *, string_split(line, ' ') AS cells FROM l),
m AS (SELECT page_id, row_no, length(line) // 4 AS tokens, len(cells) AS cells, len(list_filter(cells, lambda x: trim(x) = '')) AS empties FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY empties * 1000 // cells DESC, row_no) AS rk FROM m)
SELECT page_id, CAST(row_no AS INTEGER) AS row_no, CAST(tokens AS BIGINT) AS tokens, CAST(cells AS BIGINT) AS cells, CAST(empties AS BIGINT) AS empties,
 CAST(empties * 1000 // cells AS BIGINT) AS waste_permille FROM r WHERE rk <= 5""")
def grid_waste(t):
    rows = t.pages.select("page_id", F.posexplode(F.split("html", "<")).alias("row_no", "line"))
    cells = F.split("line", " ")
    rows = rows.select("page_id", "row_no", F.floor(F.length("line") / 4).alias("tokens"), F.size(cells).cast("bigint").alias("cells"),
                       F.size(F.filter(cells, lambda c: F.trim(c) == "")).cast("bigint").alias("empties"))
    rows = rows.withColumn("waste_permille", F.floor(F.col("empties") * 1000 / F.col("cells")))
    return head_per_key(rows, ["page_id"], [F.desc("waste_permille"), F.asc("row_no")], 5)


@query("d20_waste_summary", sql="""
WITH l AS (SELECT page_id, unnest(string_split(html, '<')) AS line FROM pages),
c AS (SELECT page_id, length(line) // 4 AS tokens, len(string_split(line, ' ')) AS cells, len(list_filter(string_split(line, ' '), lambda x: trim(x) = '')) AS empties FROM l)
SELECT page_id, CAST(COUNT(*) AS BIGINT) AS rows_seen, CAST(SUM(tokens) AS BIGINT) AS tokens, floor(SUM(tokens) * 100 / COUNT(*) + 0.5) / 100 AS mean_tokens,
 floor(SUM(empties) * 1000 / SUM(cells) + 0.5) / 1000 AS waste_ratio FROM c GROUP BY page_id""")
def waste_summary(t):
    rows = t.pages.select("page_id", F.explode(F.split("html", "<")).alias("line"))
    cells = F.split("line", " ")
    rows = rows.select("page_id", F.floor(F.length("line") / 4).alias("tokens"), F.size(cells).alias("cells"),
                       F.size(F.filter(cells, lambda c: F.trim(c) == "")).alias("empties"))
    n = F.count(F.lit(1))
    return rows.groupBy("page_id").agg(n.alias("rows_seen"), F.sum("tokens").alias("tokens"),
                                       (F.floor(F.sum("tokens") * 100 / n + 0.5) / 100).alias("mean_tokens"),
                                       (F.floor(F.sum("empties") * 1000 / F.sum("cells") + 0.5) / 1000).alias("waste_ratio"))


@query("d21_outcome_counters", sql="""
SELECT o_orderpriority, CAST(COUNT(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS created, CAST(COUNT(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS updated,
 CAST(COUNT(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS failed, bool_or(o_orderstatus = 'O') AS accepted FROM orders GROUP BY 1""")
def outcome_counters(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderpriority").agg(
        F.count_if(s == "F").alias("created"), F.count_if(s == "O").alias("updated"), F.count_if(s == "P").alias("failed"),
        F.bool_or(s == "O").alias("accepted"))


@query("d22_dictionary_catalogue", sql="""
SELECT p_brand AS model_id, p_type AS category, CAST(COUNT(*) AS BIGINT) AS entries FROM part GROUP BY 1, 2""")
def dictionary_catalogue(t):
    return t.part.groupBy(F.col("p_brand").alias("model_id"), F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("entries"))


# ---- F: ordered calculations -------------------------------------------------

@query("f1_latest_per_key", sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE rn = 1""")
def latest_per_key(t):
    return pick_last(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("f2_first_by_priority", sql=f"""WITH {SQL_RESULTS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY field_key, confidence DESC, chunk_index) AS rn FROM results)
SELECT doc_id, field_key, chunk_index FROM r WHERE rn = 1""")
def first_by_priority(t):
    return pick_first(t.chunk_results(), ["doc_id"], [F.col("field_key"), -F.col("confidence"), F.col("chunk_index")],
                      ["field_key", "chunk_index"])


@query("f3_running_offset", sql=f"""WITH {SQL_LINES}
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(COALESCE(SUM(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines""")
def running_offset(t):
    out = segmented(t.lines().select("doc_id", "line_no", F.length("line").alias("n")), ["doc_id"], ["line_no"],
                    [F.floor(F.col("line_no") / 256)], [prefix_sum(F.col("n") + 1, "start")])
    return out.select("doc_id", "line_no", "start")


@query("f4_carry_forward", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, last_value(CASE WHEN l_partkey % 3 = 0 THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM lineitem""")
def carry_forward(t):
    v = F.when(F.col("l_partkey") % 3 == 0, F.col("l_returnflag"))
    rows = t.lineitem.select("l_orderkey", *t.ROW_ORDER, "l_returnflag")
    return ranged(rows, ["l_orderkey"], t.ROW_ORDER, [carry(v, "carried")]).select(*LKEY, "carried")


@query("f5_next_row", sql="""
SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations""")
def next_row(t):
    return segmented(t.conversations, ["conv_id"], ["turn"], [F.floor(F.col("turn") / 256)],
                     [lead(F.col("role"), "next_role")]).select("conv_id", "turn", "next_role")


@query("f6_head_per_group", sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rn FROM r WHERE rn <= 10""")
def head_per_group(t):
    out = head_per_key(t.lineitem, ["l_suppkey"], [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")], 10, "rn")
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rn")


@query("f7_occurrence_index", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_orderkey, {ORD}) AS BIGINT) AS occurrence,
 CAST(COUNT(*) OVER (PARTITION BY l_returnflag, l_suppkey) AS BIGINT) AS occurrences FROM lineitem""")
def occurrence_index(t):
    order = ["l_orderkey", *t.ROW_ORDER]
    rows = t.lineitem.select("l_returnflag", *order)
    out = ranged(rows, ["l_returnflag", "l_suppkey"], order, [row_number("occurrence"), total("occurrences")])
    return out.select(*LKEY, "occurrence", "occurrences")


# ---- G: sorts, limits, paging -------------------------------------------------

@query("g1_newest_first", sql="SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_first(t):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@query("g2_offset_paging", sql="""
SELECT event_id, event_type, CAST((SELECT COUNT(*) FROM events WHERE event_type = 'view') AS BIGINT) AS total FROM events WHERE event_type = 'view'
ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40""")
def offset_paging(t):
    views = t.events.where(F.col("event_type") == "view")
    page = views.orderBy(F.desc("ts"), "event_id").offset(40).limit(20).select("event_id", "event_type")
    return page.withColumn("total", views.agg(F.count(F.lit(1))).scalar())


@query("g3_keyset_paging", sql="""
WITH c AS (SELECT ts, event_id FROM events WHERE event_id = 500)
SELECT e.event_id, e.user_id FROM events e, c WHERE (e.ts, e.event_id) < (c.ts, c.event_id) ORDER BY e.ts DESC, e.event_id DESC LIMIT 25""")
def keyset_paging(t):
    # the continuation token carries the last key of the page before
    token = t.events.where(F.col("event_id") == 500).select("ts", "event_id").first()
    if token is None:
        return t.events.limit(0).select("event_id", "user_id")
    ts, last = F.lit(token["ts"].isoformat(sep=" ")).cast("timestamp_ntz"), token["event_id"]
    older = (F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("event_id") < last))
    return t.events.where(older).orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id")


@query("g4_multi_key_sort", sql="""
WITH s AS (SELECT p_brand, p_type, p_name, COUNT(*) AS hits FROM part GROUP BY ALL)
SELECT p_brand, p_type, p_name, CAST(hits AS BIGINT) AS hits FROM s""")
def multi_key_sort(t):
    return t.part.groupBy("p_brand", "p_type", "p_name").agg(F.count(F.lit(1)).alias("hits")).orderBy(
        F.desc("hits"), "p_brand", "p_type", "p_name")


@query("g5_top_used", sql="""
SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS uses FROM orders GROUP BY 1 ORDER BY uses DESC, o_custkey LIMIT 5""")
def top_used(t):
    return report.usage(t.orders, "o_custkey").orderBy(F.desc("uses"), "o_custkey").limit(5)


@query("g5_most_recent", sql="SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def most_recent(t):
    return t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).select("o_orderkey", "o_custkey")


@query("g5_worst", sql="""
SELECT o_custkey % 25 AS model_id, CAST(COUNT(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS failed, floor(COUNT(*) FILTER (o_orderstatus = 'P') * 1000000 / COUNT(*)) / 1000000 AS share
FROM orders GROUP BY 1 ORDER BY share DESC, failed DESC, model_id LIMIT 5""")
def worst(t):
    """The models with the largest share of failed logs."""
    logs = t.logs().groupBy("model_id").agg(F.count_if(st.is_error(F.col("status"))).alias("failed"), F.count(F.lit(1)).alias("n"))
    share = (F.floor(F.col("failed") * 1_000_000 / F.col("n")) / 1_000_000).alias("share")
    return logs.select(F.col("model_id").cast("bigint").alias("model_id"), "failed", share).orderBy(F.desc("share"), F.desc("failed"), "model_id").limit(5)


@query("g6_top_regions", sql=f"""
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * (l_partkey % 40) AS area, greatest(10, 2000.0::DOUBLE * 1000 / 50000) AS floor_area,
 l_shipdate, l_extendedprice FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, l_linenumber, l_partkey, l_suppkey) AS rk FROM a WHERE area >= floor_area)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, area, rk FROM r WHERE rk <= 3""")
def top_regions(t):
    area = F.col("l_quantity") * (F.col("l_partkey") % 40)
    least = F.greatest(F.lit(10.0), F.lit(2000.0) * F.lit(1000.0) / 50000)
    big = t.lineitem.withColumn("area", area).where(F.col("area") >= least)
    out = head_per_key(big, ["l_orderkey"], [F.desc("area"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], 3, "rk")
    return out.select(*LKEY, "area", "rk")


@query("g7_most_differences", sql="""
SELECT o_orderkey, CAST(COUNT(*) AS BIGINT) AS differences FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1""")
def most_differences(t):
    diffs = t.lineitem.where(F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("differences"))
    out = t.orders.select("o_orderkey").join(diffs, F.col("o_orderkey") == F.col("l_orderkey"))
    return out.select("o_orderkey", "differences").orderBy(F.desc("differences"), "o_orderkey")


# ---- H: set operations ---------------------------------------------------------

@query("h1_ragged_union", sql="""
SELECT 'customer' AS sheet, c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def ragged_union(t):
    a = t.customer.select(F.lit("customer").alias("sheet"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.lit("supplier").alias("sheet"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("h2_union_distinct", sql="SELECT c_nationkey AS model_id FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("model_id")).union(t.supplier.select("s_nationkey")).distinct()


@query("h3_difference", sql="SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def difference(t):
    used = t.lineitem.where(F.col("l_quantity") > 40).select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(used, "p_partkey", "left_anti")


@query("h4_intersection", sql="""
SELECT n_nationkey, len(list_intersect([n_regionkey, n_nationkey % 7], [1, 3])) > 0 AS allowed FROM nation""")
def intersection(t):
    groups = F.array(F.col("n_regionkey"), F.col("n_nationkey") % 7)
    return t.nation.select("n_nationkey", F.arrays_overlap(groups, F.array(F.lit(1), F.lit(3))).alias("allowed"))


@query("h5_row_distinct", sql="""
SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem""")
def row_distinct(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return rows.unionByName(rows).dropDuplicates()


@query("h6_bulk_delete", sql="""
WITH d AS (SELECT o_orderkey, o_custkey % 50 AS requester FROM orders WHERE o_orderkey % 4 = 0)
SELECT o.o_orderkey, CASE WHEN d.o_orderkey IS NULL THEN 'kept' WHEN o.o_custkey = d.requester THEN 'deleted' ELSE 'rejected: not the owner' END AS outcome
FROM orders o LEFT JOIN d ON o.o_orderkey = d.o_orderkey""")
def bulk_delete(t):
    wanted = t.orders.where(F.col("o_orderkey") % 4 == 0).select("o_orderkey", (F.col("o_custkey") % 50).alias("requester"))
    out = t.orders.join(wanted, "o_orderkey", "left")
    return out.select("o_orderkey", F.when(F.col("requester").isNull(), "kept").when(
        F.col("o_custkey") == F.col("requester"), "deleted").otherwise("rejected: not the owner").alias("outcome"))
