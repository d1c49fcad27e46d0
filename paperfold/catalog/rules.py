"""K: user rules, extractors and routes."""

from pyspark.sql import functions as F

from paperfold.catalog.registry import query
from paperfold.catalog.reports import LKEY
from paperfold.functions import files
from paperfold.operators import rules as rl

RULES = [
    rl.Rule("surcharge", "CALCULATE", {"field": "l_quantity", "expression": "l_quantity + 50", "condition": "l_returnflag = 'R'"}),
    rl.Rule("broken", "CALCULATE", {"field": "x", "expression": "no_such_column + 1"}),
    rl.Rule("off", "CALCULATE", {"field": "l_quantity", "expression": "0"}, enabled=False),
    rl.Rule("ports", "EXPLODE", {"sources": {"pol": "pol", "pod": "pod"}}),
    rl.Rule("routes", "VALIDATE", {"check": "l_quantity > 20 AND len(pods) = 2", "severity": "error", "message": "small"}),
]


def ruled(t):
    rows = t.lineitem.select(*LKEY, "l_quantity", "l_returnflag", F.array(F.lit("A"), F.lit("B")).alias("pol"),
                             F.array("l_returnflag", "l_linestatus").alias("pod"), F.array("l_returnflag", "l_linestatus").alias("pods"))
    return rl.apply_rules(rows, RULES)


@query("k1_rule_list", sql="""
WITH q AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN l_quantity + 50 ELSE l_quantity END AS q FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, unnest(['A', 'A', 'B', 'B']) AS pol, unnest([l_returnflag, l_linestatus, l_returnflag, l_linestatus]) AS pod FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pol, pod, q AS l_quantity, CASE WHEN q > 20 THEN '' ELSE 'error:small' END AS errors FROM x""")
def rule_list(t):
    out, _ = ruled(t)
    shown = F.array_join(F.transform("validation_errors", lambda e: F.concat(e["severity"], F.lit(":"), e["message"])), ",")
    return out.select(*LKEY, "pol", "pod", "l_quantity", shown.alias("errors"))


ITEM_RULES = [
    rl.Rule("routes", "EXPLODE", {"sources": {"pol": "pol", "pod": "pod"}, "preserve": ["l_linenumber"], "output": "routes"}),
    rl.Rule("rate", "CALCULATE", {"target_list": "routes", "field": "rate", "expression": "l_partkey * 1000000"}),
    rl.Rule("sea", "CALCULATE", {"target_list": "routes", "field": "rate", "expression": "rate + l_suppkey", "condition": "pol = 'A' and l_linenumber > 1"}),
    rl.Rule("share", "CALCULATE", {"target_list": "routes", "field": "share", "expression": "cast(rate div (l_linenumber - 2) as bigint)", "condition": "pod <> 'N'"}),
]


@query("k1_list_items", sql="""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['A', 'A', 'B', 'B']) AS pol, unnest([l_returnflag, l_linestatus, l_returnflag, l_linestatus]) AS pod, unnest([0, 1, 2, 3]) AS place FROM lineitem),
r AS (SELECT *, CAST(l_partkey AS BIGINT) * 1000000 + CASE WHEN pol = 'A' AND l_linenumber > 1 THEN l_suppkey ELSE 0 END AS rate FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(place AS INTEGER) AS place, pol, pod, rate, CASE WHEN pod <> 'N' AND l_linenumber <> 2 THEN rate // (l_linenumber - 2) END AS share FROM r""")
def list_items(t):
    """Combinations as a list of rows in each record, calculated one by one."""
    rows = t.lineitem.select(*LKEY, F.array(F.lit("A"), F.lit("B")).alias("pol"), F.array("l_returnflag", "l_linestatus").alias("pod"))
    out, _ = rl.apply_rules(rows, ITEM_RULES)
    each = out.select(*LKEY, F.posexplode("routes").alias("place", "r"))
    return each.select(*LKEY, "place", "r.pol", "r.pod", "r.rate", "r.share")


@query("k2_validation", sql="""
SELECT o_orderkey, CAST((o_totalprice <= 1000) AS INTEGER) + CAST((length(o_orderpriority) <> 6) AS INTEGER) AS failures,
 CASE WHEN o_totalprice <= 1000 THEN 'warning' WHEN length(o_orderpriority) <> 6 THEN 'error' END AS first_severity FROM orders""")
def validation(t):
    rows = t.orders.withColumn("letters", F.split("o_orderpriority", ""))
    out = rl.validate(rows, "o_totalprice > 1000")
    out = rl.validate(out, "len(letters) == 6", "error", "length")
    return out.select("o_orderkey", F.size("validation_errors").alias("failures"),
                      F.try_element_at("validation_errors", F.lit(1))["severity"].alias("first_severity"))


@query("k3_user_expressions", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 2 AS DOUBLE) AS doubled, l_shipdate > TIMESTAMP '1998-01-01' AND l_quantity BETWEEN 5 AND 30 AS picked FROM lineitem""")
def user_expressions(t):
    return t.lineitem.select(*LKEY, F.expr("cast(cast(l_extendedprice as decimal(18,2)) * 2 as double)").alias("doubled"),
                             F.expr("l_shipdate > timestamp_ntz'1998-01-01' and l_quantity between 5 and 30").alias("picked"))


@query("k4_chunk_extractor", sql=rf"""
WITH c AS (SELECT page_id AS doc_id, unnest(string_split(html, '>')) AS content, generate_subscripts(string_split(html, '>'), 1) - 1 AS chunk_index FROM pages),
m AS (SELECT doc_id, chunk_index, unnest(regexp_extract_all(content, '{rl.PAIR_TEXT}', 1)) AS k, unnest(regexp_extract_all(content, '{rl.PAIR_TEXT}', 2)) AS v FROM c)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, lower(trim(k)) AS field_key, trim(v) AS value, 0.7::DOUBLE AS confidence FROM m""")
def chunk_extractor(t):
    tags = t.pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.split("html", ">")).alias("n", "content"))
    chunks = tags.select("doc_id", F.col("n").cast("bigint").alias("chunk_index"), "content")
    return rl.run_extractor(chunks, rl.key_value_extractor, rl.PAIR_SCHEMA)


@query("k5_extraction_route", sql=r"""
WITH f AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] || CASE page_id % 6 WHEN 0 THEN '.XLSX' WHEN 1 THEN '.csv' ELSE '.pdf' END AS name, length(html) AS n FROM pages)
SELECT page_id, name, CASE WHEN page_id % 6 < 2 THEN 'sheet' WHEN page_id % 10 = 3 THEN 'vision' WHEN page_id % 10 = 4 THEN 'multi_table' WHEN page_id % 10 = 5 OR n > 40000 OR n // 2000 > 2 THEN 'packed' ELSE 'single' END AS route FROM f""")
def extraction_route(t):
    k, k10 = F.col("page_id") % 6, F.col("page_id") % 10
    name = F.concat(files.file_name(F.col("url")), F.when(k == 0, ".XLSX").when(k == 1, ".csv").otherwise(".pdf"))
    n = F.length("html")
    src = t.pages.select("page_id", name.alias("name"), n.alias("n"), k10.alias("k"))
    flags = {"vision": F.col("k") == 3, "multi_table": F.col("k") == 4, "packed": F.col("k") == 5}
    return src.select("page_id", "name", rl.extraction_route(F.col("name"), F.col("n"), F.floor(F.col("n") / 2000), flags).alias("route"))
