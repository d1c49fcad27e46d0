"""C, I13, K6, E11: joins, dictionaries and locating values."""

from pyspark.sql import functions as F

from paperfold.catalog.filters import SQL_LOGS
from paperfold.catalog.registry import query
from paperfold.catalog.reports import LKEY, ORD, SQL_LINES
from paperfold.catalog.scalars import SQL_WORDS
from paperfold.functions import similarity as sim
from paperfold.functions.pieces import split_with_offsets
from paperfold.operators import fuzzy, lookups, sheets, spans
from paperfold.plans.segments import ranged_numbers


@query("c1_lookup_default", sql=f"""WITH {SQL_LOGS}
SELECT log_id, logs.user_id, COALESCE(c_name, 'Unknown') AS user_name FROM logs LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 10 > 0""")
def lookup_default(t):
    known = t.users().where(F.col("user_id") % 10 > 0)
    return lookups.with_name(t.logs().select("log_id", "user_id"), known, "user_id", "user_name")


@query("c2_active_synonyms", sql="""
SELECT s_suppkey AS id, s_name AS raw_val, n_name AS model_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 4 > 0""")
def active_synonyms(t):
    active = t.models().where(F.col("model_id") % 4 > 0)
    syn = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("raw_val"), F.col("s_nationkey").alias("model_id"))
    return syn.join(active, "model_id").select("id", "raw_val", "model_name")


@query("c3_attached_synonyms", sql="""
WITH s AS (SELECT n_regionkey AS model_id, CASE WHEN n_nationkey % 6 > 0 THEN left(n_name, 1) END AS field_name,
  CAST(n_nationkey % 3 AS VARCHAR) AS raw_val, n_name AS value, n_nationkey AS id FROM nation),
l AS (SELECT *, row_number() OVER (PARTITION BY model_id, field_name, raw_val ORDER BY id DESC) AS rn FROM s WHERE field_name IS NOT NULL)
SELECT r_regionkey AS model_id, field_name, raw_val, value, id FROM region LEFT JOIN l ON r_regionkey = model_id AND rn = 1""")
def attached_synonyms(t):
    k = F.col("n_nationkey")
    syn = t.nation.select(F.col("n_regionkey").alias("model_id"), F.when(k % 6 > 0, F.left("n_name", F.lit(1))).alias("field_name"),
                          (k % 3).cast("string").alias("raw_val"), F.col("n_name").alias("value"), k.alias("id"))
    return lookups.attach_synonyms(t.region.select(F.col("r_regionkey").alias("model_id")), syn, "id")


@query("c4_reference_replacement", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'R' ELSE 'std-' || l_returnflag END AS value,
 CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS modified_from,
 CASE l_returnflag WHEN 'A' THEN 'Vibe Dictionary' WHEN 'N' THEN 'Vibe Dictionary (Pending AI)' END AS modifier FROM lineitem""")
def reference_replacement(t):
    flag = F.col("l_returnflag")
    ref = t.lineitem.select(flag.alias("raw_val")).distinct().where(F.col("raw_val") != "R").select(
        F.when(F.col("raw_val") == "A", "flag").otherwise("charges").alias("field_name"), "raw_val",
        F.concat(F.lit("std-"), "raw_val").alias("standard"), (F.col("raw_val") == "A").alias("is_verified"))
    cells = t.lineitem.select(*LKEY, F.lit("flag").alias("sub_key"), F.lit("charges").alias("table_key"), flag.alias("value"))
    return lookups.replace_by_reference(cells, ref).select(*LKEY, "value", "modified_from", "modifier")


@query("c5_verified_synonyms", sql="""
WITH s AS (SELECT p_brand, MIN(p_type) AS standard, MIN(p_partkey) % 2 = 0 AS ok FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN ok THEN standard ELSE p.p_brand END AS value,
 CASE WHEN ok THEN CASE WHEN p_partkey % 5 = 0 THEN 'earlier' ELSE p.p_brand END WHEN p_partkey % 5 = 0 THEN 'earlier' END AS raw_value,
 CASE WHEN ok THEN 'Vibe Dictionary' END AS modifier FROM part p JOIN s ON s.p_brand = p.p_brand""")
def verified_synonyms(t):
    syn = t.part.groupBy("p_brand").agg(F.min("p_type").alias("standard"), (F.min("p_partkey") % 2 == 0).alias("is_verified")).select(
        F.lit("brand").alias("field_name"), F.col("p_brand").alias("raw_val"), "standard", "is_verified")
    cells = t.part.select("p_partkey", F.lit("brand").alias("field_key"), F.col("p_brand").alias("value"),
                          F.when(F.col("p_partkey") % 5 == 0, "earlier").alias("raw_value"))
    return lookups.replace_verified(cells, syn).drop("field_key")


def match_values(t):
    """Part names as read: as they are, with a tail, first word only, upper case, a letter lost."""
    n = F.col("p_name")
    return t.part.select(F.explode(F.array(n, F.concat(n, F.lit(" (new)")), F.split(n, " ")[0], F.upper(n),
                                           F.concat(F.left(n, F.lit(1)), F.substr(n, F.lit(3))))).alias("value"))


def match_entries(t):
    return t.dictionary().withColumn("entry_no", F.col("code").cast("bigint"))


SQL_MATCH = r"""dict AS (SELECT MIN(p_partkey) AS entry_no, CAST(MIN(p_partkey) AS VARCHAR) AS code, p_name AS name, arg_min(p_type, p_partkey) AS category FROM part GROUP BY p_name),
vals AS (SELECT DISTINCT unnest([p_name, p_name || ' (new)', string_split(p_name, ' ')[1], upper(p_name), left(p_name, 1) || substr(p_name, 3)]) AS value FROM part),
scored AS (SELECT value, category, code, name, entry_no, CASE WHEN lower(value) = name OR lower(value) = code THEN 1.0::DOUBLE
  WHEN contains(name, lower(value)) OR contains(lower(value), name) THEN 0.85::DOUBLE
  WHEN contains(code, lower(value)) OR contains(lower(value), code) THEN 0.8::DOUBLE END AS score FROM vals, dict),
best AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, category, entry_no) AS rn FROM scored WHERE score IS NOT NULL)"""


@query("c6_dictionary_match", sql=f"WITH {SQL_MATCH} SELECT value, category, code, name, entry_no, score FROM best WHERE rn = 1")
def dictionary_match(t):
    return fuzzy.match_dictionary(match_values(t), match_entries(t), fuzzy=False)


def lcs_sql(a, b):
    """Longest common subsequence of two texts of up to 125 characters: a fold over b whose state is a row of bits, one for each character of a."""
    bit = "CAST(1 AS HUGEINT) << CAST({} AS INTEGER)"
    mask = f"list_sum(list_transform(string_split({a}, ''), lambda x, k: CASE WHEN x = c THEN {bit.format('k - 1')} ELSE CAST(0 AS HUGEINT) END))"
    full = f"(({bit.format(f'length({a})')}) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda c: CAST({mask} AS HUGEINT))"
    row = f"list_reduce({masks}, lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full}, {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({row}) END"


def ratio_sql(a, b):
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100 ELSE CAST(round_even(200::DOUBLE * ({lcs_sql(a, b)}) / (length({a}) + length({b})), 0) AS BIGINT) END"


def token_set_sql(source, a, b):
    """Common table expressions: token_sets has the columns of ``source`` and ``token_set``."""
    def tokens(c):
        return rf"list_sort(list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')))"

    return f"""token_lists AS (SELECT *, {tokens(a)} AS ta, {tokens(b)} AS tb FROM {source}),
token_rests AS (SELECT *, array_to_string(list_filter(ta, lambda w: NOT list_contains(tb, w)), ' ') AS x, array_to_string(list_filter(tb, lambda w: NOT list_contains(ta, w)), ' ') AS y,
  array_to_string(list_filter(ta, lambda w: list_contains(tb, w)), ' ') AS s FROM token_lists),
token_counts AS (SELECT *, length(x) AS lx, length(y) AS ly, length(s) AS ls, CASE WHEN s = '' THEN 0 ELSE 1 END AS gap, {lcs_sql("x", "y")} AS l FROM token_rests),
token_sets AS (SELECT *, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0 WHEN s <> '' AND (x = '' OR y = '') THEN 100 ELSE CAST(round_even(greatest(
  100 - 100::DOUBLE * (lx + ly - 2 * l) / (2 * ls + 2 * gap + lx + ly),
  CASE WHEN s <> '' THEN 100 - 100::DOUBLE * (1 + lx) / (2 * ls + 1 + lx) ELSE 0 END,
  CASE WHEN s <> '' THEN 100 - 100::DOUBLE * (1 + ly) / (2 * ls + 1 + ly) ELSE 0 END), 0) AS BIGINT) END AS token_set FROM token_counts)"""


@query("c6_fuzzy_match", sql=rf"""WITH {SQL_MATCH.partition("," + chr(10) + "best AS")[0]},
pairs AS (SELECT *, lower(value) AS v FROM scored), {token_set_sql("pairs", "v", "name")},
alike AS (SELECT value, category, code, name, entry_no,
  COALESCE(score, greatest(token_set, {ratio_sql("v", "name")}, {ratio_sql("v", "code")}) / 100::DOUBLE) AS score FROM token_sets),
best AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, category, entry_no) AS rn FROM alike WHERE score >= 0.6)
SELECT value, category, code, name, entry_no, score FROM best WHERE rn = 1""")
def fuzzy_match(t):
    return fuzzy.match_dictionary(match_values(t), match_entries(t))


@query("e11_match_evidence", sql=f"""WITH {SQL_MATCH}
SELECT 'part[' || CAST(p_partkey AS VARCHAR) || '].p_name' AS path, p_name || ' (new)' AS original, code, name, category, score
FROM part JOIN best ON value = p_name || ' (new)' AND rn = 1""")
def match_evidence(t):
    cells = t.part.select(F.concat(F.lit("part["), F.col("p_partkey").cast("string"), F.lit("].p_name")).alias("path"),
                          F.concat("p_name", F.lit(" (new)")).alias("value"))
    best = fuzzy.match_dictionary(cells, match_entries(t), fuzzy=False)
    return cells.join(best, "value").select("path", F.col("value").alias("original"), "code", "name", "category", "score")


SQL_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


@query("c7_field_normalisation", sql=rf"""
WITH cells AS (SELECT p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN ' deluxe' ELSE '' END AS value, CASE WHEN p_size % 4 = 0 THEN 'ECONOMY' ELSE p_type END AS category FROM part),
entries AS (SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_type AS category FROM part),
post AS (SELECT category, code, unnest({SQL_TOKENS.format(c='name')}) AS token FROM entries),
n AS (SELECT COUNT(*) AS n FROM entries), idf AS (SELECT token, ln(1 + n / COUNT(*)) AS idf FROM post, n GROUP BY token, n),
pairs AS (SELECT DISTINCT value, category FROM cells),
words AS (SELECT value, category, w.token, COALESCE(idf, ln(1 + n)) AS idf FROM (SELECT value, category, unnest({SQL_TOKENS.format(c='value')}) AS token FROM pairs) w LEFT JOIN idf ON idf.token = w.token, n),
tot AS (SELECT value, category, SUM(idf) AS total FROM words GROUP BY ALL),
s AS (SELECT w.value, w.category, p.code, SUM(idf) AS shared FROM words w JOIN post p ON p.category = w.category AND p.token = w.token GROUP BY ALL),
r AS (SELECT s.value, s.category, code, floor(shared / total * 1000000 + 0.5) / 1000000 AS score FROM s JOIN tot ON tot.value = s.value AND tot.category = s.category),
b AS (SELECT *, row_number() OVER (PARTITION BY value, category ORDER BY score DESC, code) AS rn FROM r WHERE score > 0.5)
SELECT p_partkey, c.category, c.value AS raw_value, code AS normalized_code, COALESCE(score, 0.0::DOUBLE) AS dict_score
FROM cells c LEFT JOIN b ON b.value = c.value AND b.category = c.category AND rn = 1""")
def field_normalisation(t):
    cells = t.part.select("p_partkey", F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " deluxe").otherwise("")).alias("value"),
                          # the sub-field's category, else the one of its parent
                          F.coalesce(F.when(F.col("p_size") % 4 != 0, F.col("p_type")), F.lit("ECONOMY")).alias("category"))
    entries = t.part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return fuzzy.normalise_fields(cells, entries)


@query("c8_keyword_search", sql=rf"""
WITH entries AS (SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_type AS category FROM part),
post AS (SELECT category, code, unnest({SQL_TOKENS.format(c='name')}) AS token FROM entries),
n AS (SELECT COUNT(*) AS n FROM entries), idf AS (SELECT token, ln(1 + n / COUNT(*)) AS idf FROM post, n GROUP BY token, n),
q AS (SELECT DISTINCT p_name AS query, unnest({SQL_TOKENS.format(c='p_name')}) AS token FROM part),
h AS (SELECT query, category, code, floor(SUM(idf) * 1000000 + 0.5) / 1000000 AS score FROM q JOIN idf USING (token) JOIN post USING (token) GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY query, category ORDER BY score DESC, code) AS rc FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, category, code) AS rank FROM c WHERE rc <= 3)
SELECT query, category, code, score, rank FROM r WHERE rank <= 5""")
def keyword_search(t):
    entries = t.part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return fuzzy.search_dictionary(t.part.select(F.col("p_name").alias("query")), entries, 3, 5)


def access_tables(t):
    g = F.col("n_nationkey")
    grants = t.nation.select(g.alias("group_id"), g.alias("group_order"), F.explode(F.array((g * 3) % 25, (g + 7) % 25)).alias("model_id"),
                             F.when(g % 2 == 0, "Admin").otherwise("User").alias("role"))
    members = t.users().select("user_id", "group_id")
    # customers whose key ends in 5 also sit in the group of the key's remainder
    second = t.customer.where(F.col("c_custkey") % 10 == 5).select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 25).cast("int").alias("group_id"))
    return grants, members.union(second)


SQL_ACCESS = """grants AS (SELECT n_nationkey AS group_id, unnest([(n_nationkey * 3) % 25, (n_nationkey + 7) % 25]) AS model_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Admin' ELSE 'User' END AS role FROM nation),
members AS (SELECT c_custkey AS user_id, c_nationkey AS group_id FROM customer UNION ALL SELECT c_custkey, CAST(c_custkey % 25 AS INTEGER) FROM customer WHERE c_custkey % 10 = 5)"""


@query("c9_access_check", sql=f"""WITH {SQL_LOGS}, {SQL_ACCESS},
g AS (SELECT DISTINCT user_id, model_id FROM members JOIN grants USING (group_id))
SELECT log_id, l.user_id, l.model_id, CASE WHEN l.user_id IN (SELECT user_id FROM members WHERE group_id = 0) THEN 'super_admin'
 WHEN g.user_id IS NOT NULL THEN 'group' WHEN l.model_id % 10 = 0 THEN 'public' WHEN l.model_id * 3 = l.user_id THEN 'owner'
 WHEN l.user_id = l.model_id * 2 + 1 THEN 'user' END AS reason
FROM logs l LEFT JOIN g ON g.user_id = l.user_id AND g.model_id = l.model_id""")
def access_check(t):
    grants, members = access_tables(t)
    m = F.col("model_id")
    models = t.models().select("model_id", (m % 10 == 0).alias("is_public"), (m * 3).cast("bigint").alias("owner_id"))
    direct = t.models().select("model_id", (m * 2 + 1).cast("bigint").alias("user_id"))
    requests = t.logs().select("log_id", "user_id", "model_id")
    return lookups.check_access(requests, members.where(F.col("group_id") == 0).select("user_id"),
                                members.join(grants, "group_id"), models, direct)


@query("c10_group_role", sql=f"""WITH {SQL_ACCESS},
r AS (SELECT user_id, model_id, group_id, role, row_number() OVER (PARTITION BY user_id, model_id ORDER BY group_id) AS rn FROM members JOIN grants USING (group_id))
SELECT user_id, model_id, group_id, role FROM r WHERE rn = 1""")
def group_role(t):
    grants, members = access_tables(t)
    return lookups.first_group_role(members, grants)


@query("c11_bulk_groups", sql="""
WITH i AS (SELECT lower(c_name) || '@example.com' AS email, unnest([upper(n_name), 'ghost' || CAST(c_custkey % 3 AS VARCHAR)]) AS group_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT email, group_name, n_nationkey AS group_id, CASE WHEN c_custkey % 4 = 0 THEN 'updated' ELSE 'created' END AS outcome
FROM i LEFT JOIN nation ON lower(n_name) = lower(group_name)""")
def bulk_groups(t):
    email = F.concat(F.lower("c_name"), F.lit("@example.com"))
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    imports = own.select(email.alias("email"), F.explode(F.array(
        F.upper("n_name"), F.concat(F.lit("ghost"), (F.col("c_custkey") % 3).cast("string")))).alias("group_name"))
    groups = t.nation.select(F.col("n_name").alias("group_name"), F.col("n_nationkey").alias("group_id"))
    users = t.customer.where(F.col("c_custkey") % 4 == 0).select(F.upper(email).alias("email"))
    return lookups.resolve_groups(imports, groups, users)


SQL_CLAIMS = """claims AS (SELECT l_orderkey AS doc_id, (l_partkey * 7 + l_linenumber * 50) % 1000 AS s, (l_partkey * 7 + l_linenumber * 50) % 1000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"""


def claims(t):
    start = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 50) % 1000
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), start.alias("start"),
                             (start + F.col("l_quantity").cast("bigint")).alias("end"))


@query("c12_unclaimed_words", sql=rf"""WITH {SQL_WORDS}, {SQL_CLAIMS}
SELECT w.doc_id, start, word FROM words w WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.doc_id = w.doc_id AND c.s < w.start + length(word) AND c.e > w.start)""")
def unclaimed_words(t):
    return spans.unclaimed_words(t.words(), claims(t))


# gaps inside each line: claims clipped to the line, islands merged, complements kept
SQL_GAPS = rf"""{SQL_LINES}, {SQL_CLAIMS},
pl AS (SELECT doc_id, line_no, line, CAST(COALESCE(SUM(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ls FROM lines),
ev AS (SELECT p.doc_id, p.line_no, greatest(c.s, ls) AS s, least(c.e, ls + length(line)) AS e FROM pl p JOIN claims c ON c.doc_id = p.doc_id AND c.s < ls + length(line) AND c.e > ls
  UNION ALL SELECT doc_id, line_no, ls + length(line), ls + length(line) FROM pl UNION ALL SELECT doc_id, line_no, ls, ls FROM pl),
mx AS (SELECT *, MAX(e) OVER (PARTITION BY doc_id, line_no ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev),
gaps AS (SELECT m.doc_id, CAST(m.line_no AS INTEGER) AS line_no, reach AS gap_start, m.s AS gap_end, trim(substr(line, CAST(reach - ls + 1 AS BIGINT), CAST(m.s - reach AS BIGINT))) AS text
  FROM mx m JOIN pl p ON p.doc_id = m.doc_id AND p.line_no = m.line_no WHERE m.s - reach >= 3)"""


@query("c13_text_gaps", sql=f"WITH {SQL_GAPS} SELECT doc_id, line_no, gap_start, gap_end, text FROM gaps WHERE length(text) >= 2")
def text_gaps(t):
    return spans.text_gaps(t.placed_lines(), claims(t))


@query("c14_reference_resolution", sql="""
WITH c AS (SELECT *, CASE l_partkey % 3 WHEN 0 THEN l_orderkey WHEN 1 THEN -l_orderkey - 1 END AS ref_id, CASE WHEN l_suppkey % 4 = 0 THEN l_discount END AS conf,
  CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ref_id, CASE WHEN v = '' AND o_orderkey IS NOT NULL THEN o_orderpriority ELSE v END AS value,
 COALESCE(conf, CASE WHEN o_orderkey IS NOT NULL THEN CASE WHEN l_linenumber % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0 END WHEN ref_id IS NOT NULL THEN 0.3 ELSE 0.0 END) AS confidence,
 CASE WHEN o_orderkey IS NOT NULL THEN o_custkey % 10 END AS page_number FROM c LEFT JOIN orders ON o_orderkey = ref_id""")
def reference_resolution(t):
    k = F.col("l_partkey") % 3
    cells = t.lineitem.select(
        *LKEY, F.when(k == 0, F.col("l_orderkey")).when(k == 1, -F.col("l_orderkey") - 1).alias("ref_id"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("value"),
        F.when(F.col("l_suppkey") % 4 == 0, F.col("l_discount")).alias("confidence"), (F.col("l_linenumber") % 2 == 0).alias("is_uncertain"))
    refs = t.orders.select(F.col("o_orderkey").alias("ref_id"), F.col("o_orderpriority").alias("text"), (F.col("o_custkey") % 10).alias("page_number"))
    return spans.resolve_refs(cells, refs).drop("is_uncertain")


@query("c15_multi_references", sql="""
WITH r AS (SELECT o_orderkey AS ref_id, CAST(o_custkey % 600 AS DOUBLE) AS x1, CAST(o_orderkey % 700 AS DOUBLE) AS y1, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 10 END AS page, 'f' || CAST(o_custkey % 3 AS VARCHAR) AS file_id FROM orders),
i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([l_partkey, l_orderkey, l_suppkey]) AS ref_id, unnest([0, 1, 2]) AS pos FROM lineitem),
j AS (SELECT i.*, r.* EXCLUDE (ref_id) FROM i LEFT JOIN r ON i.ref_id = r.ref_id)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, MIN(x1) AS x1, MIN(y1) AS y1, MAX(x1 + 40) AS x2, MAX(y1 + 10) AS y2,
 arg_min(page, pos) FILTER (page IS NOT NULL) AS page_number, MAX(file_id) FILTER (pos = 0) AS file_id FROM j GROUP BY ALL""")
def multi_references(t):
    x, y = (F.col("o_custkey") % 600).cast("double"), (F.col("o_orderkey") % 700).cast("double")
    refs = t.orders.select(F.col("o_orderkey").alias("ref_id"), x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 10).alias("y2"),
                           F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") % 10).alias("page_number"),
                           F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("file_id"))
    cells = t.lineitem.select(*LKEY, F.array("l_partkey", "l_orderkey", "l_suppkey").alias("indices"))
    return spans.resolve_many(cells, LKEY, refs)


def page_words(t):
    """Words with the line they stand on as page number."""
    lines = t.lines().withColumnRenamed("line_no", "page_no")
    return split_with_offsets(lines, "line", ["doc_id", "page_no"], " ", "\r\t", piece="word", skip_empty=True)


def located_cells(t):
    """For each document every word of a benchmark passage as a value to locate."""
    items = t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("at", "value"))
    docs = t.documents.select("doc_id", (F.col("doc_id") % t.benchmark.agg(F.count(F.lit(1))).scalar()).alias("item_id"))
    cell = (F.col("doc_id") * 1000 + F.col("at")).alias("cell_id")
    return docs.join(items, "item_id").select(cell, "doc_id", "value", (F.col("doc_id") % 3).cast("int").alias("page")).where(F.col("value") != "")


SQL_PAGE_WORDS = rf"""{SQL_LINES}, tk AS (SELECT doc_id, line_no, unnest(string_split(translate(line, chr(13) || chr(9), '  '), ' ')) AS word, unnest(range(len(string_split(translate(line, chr(13) || chr(9), '  '), ' ')))) AS i FROM lines),
pw AS (SELECT doc_id, line_no AS page_no, word, CAST(COALESCE(SUM(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM tk)"""


@query("c16_locate_value", sql=rf"""WITH {SQL_PAGE_WORDS},
cells AS (SELECT doc_id * 1000 + place AS cell_id, doc_id, w AS value, doc_id % 3 AS page FROM
  (SELECT doc_id, unnest(string_split(b.text, ' ')) AS w, unnest(range(len(string_split(b.text, ' ')))) AS place FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT COUNT(*) FROM benchmark)) WHERE w <> ''),
h AS (SELECT c.cell_id, c.doc_id, value, word, page_no, start, CASE WHEN word = value THEN 0 ELSE 1 END AS tier, row_number() OVER (PARTITION BY c.cell_id ORDER BY page_no <> page, page_no, word <> value, start) AS rn
  FROM cells c JOIN pw ON pw.doc_id = c.doc_id AND word <> '' AND (word = value OR (length(word) > 1 AND (contains(value, word) OR contains(word, value)))))
SELECT cell_id, doc_id, value, word, CAST(page_no AS INTEGER) AS page_no, start, tier FROM h WHERE rn = 1""")
def locate_value(t):
    return fuzzy.locate_values(located_cells(t), page_words(t))


@query("c17_locate_fuzzy", sql=rf"""WITH {SQL_PAGE_WORDS},
asked AS (SELECT doc_id, list_reduce(list_filter(regexp_split_to_array(trim(b.text), '\s+'), lambda w: w <> ''), lambda a, w: CASE WHEN length(w) > length(a) THEN w ELSE a END) AS value
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT COUNT(*) FROM benchmark)),
pairs AS (SELECT DISTINCT value, word FROM asked JOIN pw USING (doc_id) WHERE word <> '' AND abs(length(value) - length(word)) <= 0.155 * (length(value) + length(word))),
alike AS (SELECT * FROM (SELECT value, word, {ratio_sql("value", "word")} AS score FROM pairs) WHERE score >= 85),
h AS (SELECT doc_id AS cell_id, doc_id, value, word, score, page_no, start, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_no, start) AS rn
  FROM asked JOIN alike USING (value) JOIN pw USING (doc_id, word))
SELECT cell_id, doc_id, value, word, score, CAST(page_no AS INTEGER) AS page_no, start FROM h WHERE rn = 1""")
def locate_fuzzy(t):
    items = t.benchmark.select("item_id", "text")
    docs = t.documents.select("doc_id", (F.col("doc_id") % t.benchmark.agg(F.count(F.lit(1))).scalar()).alias("item_id"))
    cells = docs.join(items, "item_id").select(F.col("doc_id").alias("cell_id"), "doc_id", F.col("text").alias("source_text"))
    return fuzzy.locate_fuzzy(cells, page_words(t))


@query("c17_locate_passage")
def locate_passage(t):
    """A whole benchmark passage among the lines of each document."""
    n = t.benchmark.agg(F.count(F.lit(1))).scalar()
    docs = t.documents.select("doc_id", (F.col("doc_id") % n).alias("item_id"))
    # one target per document and one without, so that both page rules are met
    targets = docs.join(t.benchmark, "item_id").select(
        F.col("doc_id").alias("target_id"), "doc_id", "text",
        F.when(F.col("doc_id") % 2 == 0, 0).alias("page"))
    refs = t.lines().select("doc_id", F.col("line_no").alias("ref_no"), F.col("line_no").alias("page_no"), F.col("line").alias("text"))
    return fuzzy.locate_passages(targets, refs)


@query("c18_expected_check", sql=r"""
WITH t AS (SELECT c_custkey, c_name AS expected, CASE c_custkey % 4 WHEN 0 THEN ' ' || replace(c_name, '#', ' # ') WHEN 1 THEN substr(c_name, 2) WHEN 2 THEN NULL ELSE 'other' END AS value FROM customer)
SELECT c_custkey, value, expected, CASE WHEN c_custkey % 4 = 0 THEN 'PASS' ELSE 'FAIL' END AS strict, CASE WHEN c_custkey % 4 < 2 THEN 'PASS' ELSE 'FAIL' END AS lenient FROM t""")
def expected_check(t):
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    value = (F.when(k == 0, F.concat(F.lit(" "), F.regexp_replace(n, "#", " # "))).when(k == 1, F.substr(n, F.lit(2))).when(k == 3, "other"))
    rows = t.customer.select("c_custkey", value.alias("value"))
    return lookups.expected_check(rows, t.customer.select("c_custkey", n.alias("expected")), "c_custkey")


SQL_GRID = f"""grid AS (SELECT 'Sheet' || CAST(l_suppkey % 3 AS VARCHAR) AS sheet, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_orderkey, {ORD}) - 1 AS BIGINT) AS local_row_id,
  CAST(l_partkey AS VARCHAR) AS "A", CASE WHEN l_returnflag = 'R' THEN 'nan' ELSE l_returnflag END AS "B", CASE WHEN l_linestatus = 'O' THEN ' ' ELSE l_linestatus END AS "C" FROM lineitem)"""


def grid(t, sheet=None):
    rows = t.lineitem.withColumn("sheet", F.concat(F.lit("Sheet"), (F.col("l_suppkey") % 3).cast("string")))
    rows = sheets.pick_sheet(rows, sheet)
    order = ["l_orderkey", *t.ROW_ORDER]
    rows = ranged_numbers(rows.select("sheet", *order, "l_returnflag", "l_linestatus"), ["sheet"], order, "local_row_id")
    return rows.select("sheet", *LKEY, (F.col("local_row_id") - 1).alias("local_row_id"), F.col("l_partkey").cast("string").alias("A"),
                       F.when(F.col("l_returnflag") == "R", "nan").otherwise(F.col("l_returnflag")).alias("B"),
                       F.when(F.col("l_linestatus") == "O", " ").otherwise(F.col("l_linestatus")).alias("C"))


@query("c19_sheet_mapping", sql=f"""WITH {SQL_GRID},
m AS (SELECT local_row_id, unnest(['flag', 'state', 'ghost']) AS sub_key, unnest([CASE WHEN "B" <> 'nan' THEN "B" END, NULLIF(trim("C"), ''), NULL]) AS value
  FROM grid WHERE sheet = 'Sheet1' AND local_row_id >= 2 AND ("B" <> 'nan' OR trim("C") <> ''))
SELECT local_row_id, sub_key, value, CASE WHEN value IS NULL THEN 'blank' ELSE 'valid' END AS status FROM m""")
def sheet_mapping(t):
    g = grid(t, " sheet1 ").withColumn("row_id", F.col("local_row_id"))
    table = sheets.map_table(g, {"flag": "B", "state": "C", "ghost": None}, 2)
    return sheets.to_cells(table, ["flag", "state", "ghost"]).select("local_row_id", "sub_key", "value", "status")


@query("c20_scalar_by_coordinate", sql="""
WITH w AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'D' ELSE 'Z' END AS col FROM supplier)
SELECT w.s_suppkey AS row_id, col, CASE col WHEN 'B' THEN s_name WHEN 'D' THEN CAST(s_nationkey AS VARCHAR) ELSE 'literal' END AS value FROM w JOIN supplier s ON s.s_suppkey = w.s_suppkey""")
def scalar_by_coordinate(t):
    g = t.supplier.select(F.lit("main").alias("sheet"), F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("B"), F.col("s_nationkey").cast("string").alias("D"))
    k = F.col("s_suppkey") % 3
    wanted = t.supplier.select(F.lit("main").alias("sheet"), F.col("s_suppkey").alias("row_id"),
                               F.when(k == 0, "B").when(k == 1, "D").otherwise("Z").alias("col"), F.lit(" literal ").alias("fallback"))
    return sheets.scalars(g, wanted, ["B", "D"]).select("row_id", "col", "value")


def jobs(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("log_id"), F.concat_ws("-", "l_partkey", "l_linenumber", "l_suppkey").alias("job_id"), F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_linenumber") % 2 == 0, "S100").alias("status"), F.col("l_returnflag").alias("error"), F.col("l_partkey").alias("candidates"))


SQL_JOBS = """j AS (SELECT l_orderkey AS log_id, concat_ws('-', l_partkey, l_linenumber, l_suppkey) AS job_id, CASE WHEN l_linenumber % 2 = 0 THEN 'S100' END AS status, l_returnflag AS error, l_partkey AS candidates,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, concat_ws('-', l_partkey, l_linenumber, l_suppkey) DESC) AS rn FROM lineitem)"""


@query("c21_latest_job_sync", sql=f"""WITH {SQL_LOGS}, {SQL_JOBS}
SELECT logs.log_id, COALESCE(j.status, logs.status) AS status, j.error, j.job_id FROM logs LEFT JOIN j ON j.log_id = logs.log_id AND rn = 1""")
def latest_job_sync(t):
    logs = t.logs().select("log_id", "status", F.lit(None).cast("string").alias("error"))
    return lookups.propagate(logs, jobs(t), ["status", "error", "candidates"])


@query("c22_header_to_rows", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def header_to_rows(t):
    head = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderstatus")
    return t.lineitem.select(*LKEY).join(head, "l_orderkey")


@query("c23_retry_plan", sql=f"""WITH {SQL_LOGS}, {SQL_JOBS},
l AS (SELECT log_id, model_id, CASE WHEN log_id % 7 > 0 THEN 'f' END AS file_url FROM logs WHERE status = 'E100')
SELECT l.log_id, model_id, CASE WHEN file_url IS NOT NULL AND model_id % 6 > 0 THEN 'P100' END AS status,
 CASE WHEN file_url IS NOT NULL AND model_id % 6 > 0 THEN candidates END AS candidates,
 CASE WHEN file_url IS NULL THEN 'no file' WHEN model_id % 6 = 0 THEN 'model not found' END AS reject_reason
FROM l LEFT JOIN j ON j.log_id = l.log_id AND rn = 1""")
def retry_plan(t):
    logs = t.logs().where(F.col("status") == "E100").select("log_id", "model_id", F.when(F.col("log_id") % 7 > 0, "f").alias("file_url"))
    return lookups.plan_retries(logs, t.models().where(F.col("model_id") % 6 > 0), jobs(t))


@query("c24_publish", sql="""
WITH m AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 1 THEN 'DRAFT' ELSE 'PUBLISHED' END AS status, 'v' || CAST(n_nationkey AS VARCHAR) || CASE WHEN n_nationkey % 3 = 1 THEN '-draft' ELSE '' END AS version,
  CASE WHEN n_nationkey % 3 = 1 THEN n_nationkey - 1 END AS parent FROM nation),
p AS (SELECT id, parent FROM m WHERE status = 'DRAFT' AND id % 2 = 0)
SELECT id AS model_id, parent AS parent_id, CASE WHEN id IN (SELECT id FROM p) THEN 'PUBLISHED' WHEN id IN (SELECT parent FROM p) THEN 'ARCHIVED' ELSE status END AS status,
 CASE WHEN id IN (SELECT id FROM p) THEN replace(version, '-draft', '') ELSE version END AS version FROM m""")
def publish(t):
    k = F.col("n_nationkey")
    draft = k % 3 == 1
    models = t.nation.select(
        k.alias("model_id"), F.when(draft, k - 1).alias("parent_id"), F.when(draft, "DRAFT").otherwise("PUBLISHED").alias("status"),
        F.concat(F.lit("v"), k.cast("string"), F.when(draft, "-draft").otherwise("")).alias("version"))
    return lookups.publish(models, t.nation.where(k % 2 == 0).select(k.alias("model_id")))


SQL_STRETCHES = f"""stretches AS (SELECT p_partkey, short, substr(long, greatest(i, 0) + 1, least(i + length(short), length(long)) - greatest(i, 0)) AS part
  FROM (SELECT *, unnest(range(1 - length(short), length(long))) AS i FROM (SELECT p_partkey,
    CASE WHEN length(p_name) <= length(other) THEN p_name ELSE other END AS short, CASE WHEN length(p_name) <= length(other) THEN other ELSE p_name END AS long FROM pairs))),
parts AS (SELECT p_partkey, CAST(round_even(max(200::DOUBLE * ({lcs_sql("short", "part")}) / (length(short) + length(part))), 0) AS BIGINT) AS partial FROM stretches GROUP BY 1)"""


@query("i13_similarity", sql=f"""WITH pairs AS (SELECT a.p_partkey, a.p_name, b.p_name AS other FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
{token_set_sql("pairs", "p_name", "other")}, {SQL_STRETCHES}
SELECT p_partkey, p_name, other, {ratio_sql("p_name", "other")} AS ratio, token_set, partial FROM token_sets JOIN parts USING (p_partkey)""")
def similarity(t):
    nxt = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    pairs = t.part.select("p_partkey", "p_name").join(nxt, "p_partkey")
    return pairs.withColumns({"ratio": sim.ratio_udf("p_name", "other"), "token_set": sim.token_set_ratio_udf("p_name", "other"),
                              "partial": sim.partial_ratio_udf("p_name", "other")})


@query("k6_scorer_on_distinct", sql=f"""
SELECT a.p_partkey, a.p_brand, b.p_type AS other, {ratio_sql("a.p_brand", "b.p_type")} AS score FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def scorer_on_distinct(t):
    """The scorer sees each distinct pair once; the scores are joined back."""
    nxt = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("other"))
    pairs = t.part.select("p_partkey", "p_brand").join(nxt, "p_partkey")
    scores = pairs.select("p_brand", "other").distinct().withColumn("score", sim.ratio_udf("p_brand", "other"))
    return pairs.join(scores, ["p_brand", "other"])
