"""I: scalar functions over whole tables."""

from pyspark.sql import functions as F

from paperfold.catalog.registry import query
from paperfold.functions import boxes, dates, files
from paperfold.functions import numbers as num
from paperfold.functions import text as tx
from paperfold.operators.constraints import apply_post_rules, constraint_status

# DuckDB text of the numeric shape used by the number guard.
SHAPE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def price_text(key, price):
    """Price as the texts a document may carry: marks, words, bare, broken."""
    p = price.cast("decimal(18,2)").cast("string")
    k = key % 6
    return (
        F.when(k == 0, F.concat(F.lit("₩"), F.regexp_replace(p, r"([0-9])([0-9]{3})\.", "$1,$2.")))
        .when(k == 1, F.concat(p, F.lit("원")))
        .when(k == 2, F.concat(F.lit(" $"), p))
        .when(k == 3, F.concat(p, F.lit("d")))
        .when(k == 4, F.lit("nan"))
        .otherwise(p)
    )


PRICE_TEXT = r"""CASE {k} % 6
  WHEN 0 THEN '₩' || regexp_replace(CAST(CAST({p} AS DECIMAL(18,2)) AS VARCHAR), '([0-9])([0-9]{{3}})\.', '\1,\2.')
  WHEN 1 THEN CAST(CAST({p} AS DECIMAL(18,2)) AS VARCHAR) || '원'
  WHEN 2 THEN ' $' || CAST(CAST({p} AS DECIMAL(18,2)) AS VARCHAR)
  WHEN 3 THEN CAST(CAST({p} AS DECIMAL(18,2)) AS VARCHAR) || 'd'
  WHEN 4 THEN 'nan'
  ELSE CAST(CAST({p} AS DECIMAL(18,2)) AS VARCHAR) END"""


@query("i1_parse_number", sql=rf"""
WITH t AS (SELECT o_orderkey, {PRICE_TEXT.format(k='o_orderkey', p='o_totalprice')} AS raw FROM orders),
b AS (SELECT *, trim(regexp_replace(raw, '[,₩$원]', '', 'g')) AS bare FROM t)
SELECT o_orderkey, raw, CASE WHEN regexp_matches(bare, '{SHAPE}') THEN TRY_CAST(bare AS DOUBLE) END AS amount
FROM b""")
def parse_number(t):
    raw = price_text(F.col("o_orderkey"), F.col("o_totalprice"))
    return t.orders.select("o_orderkey", raw.alias("raw")).withColumn("amount", num.parse_number(F.col("raw")))


@query("i2_parse_date", sql=r"""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5
   WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
   WHEN 1 THEN strftime(o_orderdate, '%Y') || '년 ' || CAST(month(o_orderdate) AS VARCHAR) || '월 ' || CAST(day(o_orderdate) AS VARCHAR) || '일'
   WHEN 2 THEN strftime(o_orderdate, '%Y') || '.' || CAST(month(o_orderdate) AS VARCHAR) || '.' || CAST(day(o_orderdate) AS VARCHAR)
   WHEN 3 THEN CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR) || '/' || strftime(o_orderdate, '%Y')
   ELSE 'about ' || strftime(o_orderdate, '%Y') END AS raw, o_orderdate FROM orders)
SELECT o_orderkey, raw, CASE WHEN o_orderkey % 5 = 4 THEN raw ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso
FROM t""")
def parse_date(t):
    d = F.col("o_orderdate")
    y, m, day = F.date_format(d, "yyyy"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")
    k = F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.concat(y, F.lit("년 "), m, F.lit("월 "), day, F.lit("일")))
        .when(k == 2, F.concat_ws(".", y, m, day))
        .when(k == 3, F.concat_ws("/", m, day, y))
        .otherwise(F.concat(F.lit("about "), y))
    )
    return t.orders.select("o_orderkey", raw.alias("raw")).withColumn("iso", dates.parse_date(F.col("raw")))


@query("i3_split_currency", sql=r"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS p,
  CASE l_partkey % 4 WHEN 0 THEN 'usd ' WHEN 1 THEN 'EUR' WHEN 2 THEN ' KRW' ELSE '' END AS cur,
  CASE WHEN l_suppkey % 2 = 0 THEN 'JPY' END AS existing FROM lineitem),
r AS (SELECT *, CASE WHEN l_partkey % 4 = 2 THEN p || cur ELSE cur || p END AS raw FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, raw,
  p AS amount, COALESCE(existing, NULLIF(upper(trim(cur)), '')) AS currency
FROM r""")
def split_currency(t):
    p = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    k = F.col("l_partkey") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("usd "), p)).when(k == 1, F.concat(F.lit("EUR"), p))
        .when(k == 2, F.concat(p, F.lit(" KRW"))).otherwise(p)
    )
    existing = F.when(F.col("l_suppkey") % 2 == 0, F.lit("JPY"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"), existing.alias("existing")
    ).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "raw",
        F.coalesce(num.currency_amount(F.col("raw")), F.col("raw")).alias("amount"),
        F.coalesce("existing", num.currency_code(F.col("raw"))).alias("currency"),
    )


@query("i4_extract_digits", sql="""
SELECT c_custkey, regexp_replace(c_name, '[^0-9.]', '', 'g') AS digits FROM customer""")
def extract_digits(t):
    return t.customer.select("c_custkey", tx.digits_only(F.col("c_name")).alias("digits"))


@query("i5_uppercase", sql="SELECT p_partkey, upper(p_name) AS name FROM part")
def uppercase(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("name"))


@query("i6_iso_separators", sql="""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""")
def iso_separators(t):
    pattern = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy.MM.dd"))
    raw = F.coalesce(pattern, F.date_format("o_orderdate", "yyyy/MM/dd"))
    return t.orders.select("o_orderkey", tx.iso_separators(raw).alias("iso"))


@query("i7_split_delimiter", sql="""
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS piece,
       CAST(unnest(range(len(string_split(p_name, ' ')))) AS INTEGER) AS pos FROM part""")
def split_delimiter(t):
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "piece"))


@query("i8_rule_chain", sql=r"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
   CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS p,
   CASE l_partkey % 3 WHEN 0 THEN 'usd ' WHEN 1 THEN '#' ELSE '' END AS pre FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p AS value,
  CASE l_partkey % 3 WHEN 0 THEN 'Rule: Split Currency' WHEN 1 THEN 'Rule: Extract Digits' END AS modifier,
  CASE WHEN l_partkey % 3 < 2 THEN pre || p END AS modified_from FROM t""")
def rule_chain(t):
    p = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    k = F.col("l_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("usd "), p)).when(k == 1, F.concat(F.lit("#"), p)).otherwise(p)
    out = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("value"))
    return apply_post_rules(out, "value", ["split_currency", "extract_digits", "uppercase"])


@query("i9_constraint_status", sql=rf"""
WITH t AS (SELECT o_orderkey, {PRICE_TEXT.format(k='o_orderkey', p='o_totalprice')} AS amount,
   CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderpriority END AS priority,
   CASE WHEN o_orderkey % 3 = 0 THEN '1.1' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
   CASE o_orderkey % 3 WHEN 0 THEN '{{"a": 1}}' WHEN 1 THEN '{{"a": }}' ELSE 'text' END AS body FROM orders)
SELECT o_orderkey,
  CASE WHEN NOT regexp_matches(trim(regexp_replace(amount, '[,₩$원]', '', 'g')), '{SHAPE}') THEN 'error_type_mismatch' ELSE 'valid' END AS amount_status,
  CASE WHEN priority IS NULL OR priority = '' THEN 'error_missing_required'
       WHEN NOT regexp_matches(priority, '^(?:[1-3]-)') THEN 'error_format_invalid' ELSE 'valid' END AS priority_status,
  CASE WHEN length(day) < 6 THEN 'error_date_format' ELSE 'valid' END AS day_status,
  CASE WHEN o_orderkey % 3 = 1 THEN 'error_json_format' ELSE 'valid' END AS body_status
FROM t""")
def constraints(t):
    k = F.col("o_orderkey")
    src = t.orders.select(
        "o_orderkey",
        price_text(k, F.col("o_totalprice")).alias("amount"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, None).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 3 == 0, "1.1").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(k % 3 == 0, '{"a": 1}').when(k % 3 == 1, '{"a": }').otherwise("text").alias("body"),
    )
    return src.select(
        "o_orderkey",
        constraint_status(F.col("amount"), "number").alias("amount_status"),
        constraint_status(F.col("priority"), "string", True, "[1-3]-").alias("priority_status"),
        constraint_status(F.col("day"), "date").alias("day_status"),
        constraint_status(F.col("body"), "object").alias("body_status"),
    )


@query("i10_box_objects", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 < 2 THEN CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_linenumber + 1 AS VARCHAR) || ',' ||
 CAST(l_linenumber + 10 AS VARCHAR) || ',' || CAST(l_linenumber + 21 AS VARCHAR) END AS rect FROM lineitem""")
def box_objects(t):
    x = F.col("l_linenumber").cast("double")
    named = lambda **c: F.create_map(*[v for k, e in c.items() for v in (F.lit(k), e)])
    box = (F.when(F.col("l_partkey") % 3 == 0, named(x1=x, y1=x + 1, x2=x + 10, y2=x + 21))
           .when(F.col("l_partkey") % 3 == 1, named(x=x, y=x + 1, w=F.lit(10.0), h=F.lit(20.0))).otherwise(named(x=x, y=x)))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", boxes.box_text(boxes.object_rect(box), 0).alias("rect"))


@query("i10_normalize_bbox", sql=r"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 5 AS k,
   l_quantity AS x, l_linenumber * 10.0::DOUBLE AS y FROM lineitem),
r AS (SELECT *,
   CASE k WHEN 0 THEN x / 100 WHEN 1 THEN x / 10 WHEN 2 THEN x + 200 WHEN 3 THEN x + 30 ELSE x END AS x1,
   CASE k WHEN 0 THEN y / 100 WHEN 1 THEN y / 10 WHEN 2 THEN y + 200 WHEN 3 THEN y ELSE y END AS y1,
   CASE k WHEN 0 THEN x / 100 + 0.1 WHEN 1 THEN x / 10 + 1 WHEN 2 THEN x + 260 WHEN 3 THEN x + 40 ELSE x END AS x2,
   CASE k WHEN 0 THEN y / 100 + 0.1 WHEN 1 THEN y / 10 + 1 WHEN 2 THEN y + 260 WHEN 3 THEN y + 9 ELSE y + 1 END AS y2,
   CASE WHEN k = 3 THEN 200.0::DOUBLE ELSE 0 END AS w, CASE WHEN k = 3 THEN 400.0::DOUBLE ELSE 0 END AS h FROM b),
s AS (SELECT *, CASE WHEN w > 0 THEN w WHEN greatest(x1, y1, x2, y2) < 1 THEN 1
        WHEN greatest(x1, y1, x2, y2) <= 20 THEN 8.5 WHEN x2 > 100 OR y2 > 100 THEN greatest(x2 * 1.1::DOUBLE, 612) ELSE 100 END AS dw,
      CASE WHEN h > 0 THEN h WHEN greatest(x1, y1, x2, y2) < 1 THEN 1
        WHEN greatest(x1, y1, x2, y2) <= 20 THEN 11 WHEN x2 > 100 OR y2 > 100 THEN greatest(y2 * 1.1::DOUBLE, 792) ELSE 100 END AS dh FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN x2 > x1 AND y2 > y1 THEN
    CAST(CAST(floor(x1 / dw * 100 * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(y1 / dh * 100 * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ',' ||
    CAST(CAST(floor(x2 / dw * 100 * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(y2 / dh * 100 * 1000 + 0.5) AS BIGINT) AS VARCHAR) END AS bbox
FROM s""")
def normalize_bbox(t):
    k, x, y = F.col("l_partkey") % 5, F.col("l_quantity"), F.col("l_linenumber") * 10.0
    pick = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).when(k == 2, v[2]).when(k == 3, v[3]).otherwise(v[4])
    x1 = pick(x / 100, x / 10, x + 200, x + 30, x)
    y1 = pick(y / 100, y / 10, y + 200, y, y)
    x2 = pick(x / 100 + 0.1, x / 10 + 1, x + 260, x + 40, x)
    y2 = pick(y / 100 + 0.1, y / 10 + 1, y + 260, y + 9, y + 1)
    # every other row carries the box as an 8-number polygon
    box = F.when(F.col("l_suppkey") % 2 == 0, F.array(x1, y1, x2, y1, x2, y2, x1, y2)).otherwise(F.array(x1, y1, x2, y2))
    src = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box.alias("box"),
        F.when(k == 3, 200.0).otherwise(0.0).alias("w"), F.when(k == 3, 400.0).otherwise(0.0).alias("h"),
    )
    out = boxes.to_percent(src, "box", "w", "h", "pct")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", boxes.box_text(F.col("pct")).alias("bbox"))


@query("i11_token_estimate", sql="""
SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens, CAST(length(text) // 3 AS BIGINT) AS fallback_tokens
FROM documents""")
def token_estimate(t):
    return t.documents.select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"),
                              tx.token_estimate(F.col("text"), 3).alias("fallback_tokens"))


# words of the documents with offsets, as DuckDB reads them
SQL_WORDS = r"""
 flat AS (SELECT doc_id, string_split(translate(text, chr(10) || chr(13) || chr(9), '   '), ' ') AS a FROM documents),
 toks AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS i FROM flat),
 offs AS (SELECT doc_id, word, CAST(COALESCE(SUM(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM toks),
 words AS (SELECT doc_id, start, word FROM offs WHERE word <> '')"""


@query("i12_entity_words", sql=rf"""
WITH {SQL_WORDS}
SELECT doc_id, start, word FROM words
WHERE regexp_matches(word, '[0-9]') OR (length(word) > 2 AND upper(word) <> lower(word) AND word = upper(word))
   OR regexp_matches(word, '[$€£₩]') OR (length(word) >= 2 AND regexp_matches(word, '[가-힣]'))""")
def entity_words(t):
    return t.words().where(tx.is_entity(F.col("word")))


@query("i14_edit_distance", sql="""
WITH t AS (SELECT c_custkey, c_name, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN substr(c_name, 2)
   WHEN 2 THEN c_name || 'x' ELSE 'yz' || substr(c_name, 3) END AS other FROM customer)
SELECT c_custkey, other, levenshtein(c_name, other) <= 1 AS close FROM t""")
def edit_distance(t):
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    other = (F.when(k == 0, n).when(k == 1, F.substr(n, F.lit(2))).when(k == 2, F.concat(n, F.lit("x")))
             .otherwise(F.concat(F.lit("yz"), F.substr(n, F.lit(3)))))
    return t.customer.select("c_custkey", "c_name", other.alias("other")).select(
        "c_custkey", "other", (F.levenshtein("c_name", "other", 1) >= 0).alias("close"))


@query("i15_content_keys", sql="""
SELECT p_partkey, sha256(p_type || '|' || p_brand) AS schema_key, md5(p_type || '|' || CAST(p_partkey AS VARCHAR) || '|' || p_name) AS row_key
FROM part""")
def content_keys(t):
    return t.part.select(
        "p_partkey", F.sha2(F.concat_ws("|", "p_type", "p_brand"), 256).alias("schema_key"),
        F.md5(F.concat_ws("|", "p_type", F.col("p_partkey").cast("string"), "p_name")).alias("row_key"))


@query("i16_safe_names", sql="""
SELECT n_nationkey AS nation_key, n_name AS name, n_regionkey AS field_2 FROM nation""")
def safe_names(t):
    return t.nation.toDF(*files.safe_names(["nation key", "name", "3rd column"]))


@query("i17_display_formats", sql=r"""
SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '₩' || format('{:,.2f}', o_totalprice) END AS money,
  format('{:,.2f}', o_totalprice) AS amount,
  CAST(o_custkey AS VARCHAR) || '%' AS share, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def display_formats(t):
    price = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    return t.orders.select(
        "o_orderkey", num.shown(price, "currency").alias("money"),
        num.shown(F.col("o_totalprice"), "number").alias("amount"),
        num.shown(F.col("o_custkey"), "percent").alias("share"),
        num.shown(F.col("o_orderdate"), "date").alias("day"))


@query("i18_confidence_band", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN l_discount * 10 >= 0.9 THEN 'high' WHEN l_discount * 10 >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM lineitem""")
def band(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             num.confidence_band(F.col("l_discount") * 10).alias("band"))


@query("i19_text_cap", sql="""
SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '... (truncated)' ELSE text END AS shown FROM documents""")
def text_cap(t):
    return t.documents.select("doc_id", tx.capped(F.col("text"), 1000).alias("shown"))


@query("i20_file_type", sql=r"""
WITH f AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] ||
   CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.png' WHEN 3 THEN '.html' ELSE '' END AS name FROM pages)
SELECT page_id, name, CASE lower(regexp_extract(name, '\.[^./?#]+$'))
  WHEN '.pdf' THEN 'application/pdf' WHEN '.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
  WHEN '.png' THEN 'image/png' WHEN '.html' THEN 'text/html' ELSE 'application/octet-stream' END AS file_type FROM f""")
def file_types(t):
    k = F.col("page_id") % 5
    tail = F.when(k == 0, ".PDF").when(k == 1, ".xlsx").when(k == 2, ".png").when(k == 3, ".html").otherwise("")
    name = F.concat(files.file_name(F.col("url")), tail)
    return t.pages.select("page_id", name.alias("name")).withColumn("file_type", files.file_type(F.col("name")))


@query("i21_retention", sql="""
SELECT o_orderkey, strftime(o_orderdate + to_seconds((o_orderkey % 30 + 1) * 86400), '%Y-%m-%d %H:%M:%S') AS expires_at FROM orders""")
def retention(t):
    due = dates.expires_at(F.col("o_orderdate"), F.col("o_orderkey") % 30 + 1)
    return t.orders.select("o_orderkey", F.date_format(due, "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@query("i22_compare_key", sql=r"""
SELECT c_custkey, replace(c_name, '#', '') AS compare_key FROM customer""")
def compare_key(t):
    spaced = F.regexp_replace("c_name", "#", " \t")
    return t.customer.select("c_custkey", tx.compare_key(spaced).alias("compare_key"))
