"""The registered queries of these operators: (spark, folder) -> DataFrame over whole tables, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.llm import fingerprints, leaks, merkle, neardup, packing, quality, records, secret_scan, slots, surrogates, token_counts, trie, warc
from paperfold.llm.common import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(prepared(spark), folder)

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@register
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, folder), width=2, similarity=0.8)


SQL["op2_near_duplicates"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM split
), sized AS (SELECT doc_id, s, len(s) AS n FROM sets
), copies AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep, s FROM sized
), items AS (SELECT doc_id, n, unnest(s) AS x FROM copies WHERE doc_id = rep
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b
    ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY ALL HAVING count(*) * 100 >= (any_value(a.n) + any_value(b.n) - count(*)) * 80
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles,
  CASE WHEN c.n = 0 THEN c.doc_id ELSE least(c.rep, coalesce(l.m, c.rep)) END AS component_id,
  c.n = 0 OR c.doc_id = least(c.rep, coalesce(l.m, c.rep)) AS kept
FROM copies c LEFT JOIN least_of l ON c.rep = l.a
"""


@register
def op3_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    return slots.assign(documents(spark, folder), shards=24)


@register
def op5_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), capacity=1024)


@register
def op10_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.for_every_limit(token_counts.counted(documents(spark, folder)))


@register
def op9_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@register
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.judged(documents(spark, folder), labels, host=F.col("source"), path=F.col("lang"), keep=["doc_id"])


@register
def op4_guess_cost(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(documents(spark, folder)))


@register
def op7_zstd_archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read(warc.write(spark.read.parquet(f"{folder}/pages.parquet")))


SQL["op7_zstd_archives"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g
"""


@register
def op8_prefix_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_next(documents(spark, folder))


@register
def op6_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replaced(documents(spark, folder).select("doc_id", "text"), key="corpus")


@register
def op11_binary_records(spark: SparkSession, folder: str) -> DataFrame:
    return records.read(records.write(documents(spark, folder))).drop("position")


@register
def op12_butterfly_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    own = merkle.leaf_of(*[F.col(c) for c in merkle.FIELDS])
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf_of(*[lowered if c == "text" else F.col(c) for c in merkle.FIELDS])
    now = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered)
    found = merkle.manifest(docs.select("lang", "doc_id", own.alias("leaf"), now.alias("now")), carry=["now"])
    found = found.withColumn("folded_root", merkle.fold(F.col("path"), F.coalesce("now", "leaf")))
    proof = merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# crc(id, v): unsigned CRC-32 of the decimal digits of the ids of a table ids(id), in common table expressions
_CRC = """
crc_bits(b, k, v) AS (SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8
), crc_bytes AS (SELECT b, v FROM crc_bits WHERE k = 8
), crc_steps(id, k, v) AS (SELECT id, 0, 4294967295::BIGINT FROM ids WHERE id IS NOT NULL
  UNION ALL SELECT s.id, s.k + 1, xor(s.v >> 8, t.v) FROM crc_steps s
    JOIN crc_bytes t ON t.b = xor(s.v, ascii(substr(s.id::VARCHAR, s.k + 1, 1))) & 255 WHERE s.k < length(s.id::VARCHAR)
), crc AS (SELECT id, xor(v, 4294967295::BIGINT) AS v FROM crc_steps WHERE k = length(id::VARCHAR)
)"""


def _leaf_sql(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}))::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


SQL["op12_butterfly_manifest"] = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id AS id FROM documents
), {_CRC}, leaves AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
    CASE WHEN c.v % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS now
  FROM documents LEFT JOIN crc c ON c.id = doc_id
), trees AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)
), placed AS (
  SELECT l.*, t.tree, row_number() OVER (ORDER BY t.tree, doc_id NULLS FIRST, leaf) AS rid,
    row_number() OVER (PARTITION BY t.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY t.tree) AS n
  FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang
), nodes(tree, level, pos, digest, n) AS (SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8
), roots AS (SELECT tree, digest, max(level) OVER () AS most, count(*) OVER () AS n FROM nodes WHERE n = 1
), above(level, pos, digest, n) AS (SELECT 0, tree, digest, n FROM roots
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM above WHERE n > 1 GROUP BY level, pos // 8
), steps AS (
  SELECT p.rid, s.level, s.pos, p.pos // CAST(pow(8, s.level) AS BIGINT) AS own, s.digest FROM placed p
    JOIN nodes s ON s.tree = p.tree AND s.n > 1 AND s.pos // 8 = p.pos // CAST(pow(8, s.level + 1) AS BIGINT)
  UNION ALL SELECT p.rid, 100 + s.level, s.pos, p.tree // CAST(pow(8, s.level) AS BIGINT), s.digest FROM placed p
    JOIN above s ON s.n > 1 AND s.pos // 8 = p.tree // CAST(pow(8, s.level + 1) AS BIGINT)
), parts AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY level) AS k, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < own), '') AS a,
    coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > own), '') AS b FROM steps GROUP BY rid, level
), proofs AS (SELECT rid, max(k) AS steps, sha256(string_agg(a || b, '' ORDER BY k)) AS proof FROM parts GROUP BY rid
), folded(rid, k, digest) AS (SELECT rid, 0, coalesce(now, leaf) FROM placed
  UNION ALL SELECT f.rid, f.k + 1, sha256(s.a || f.digest || s.b) FROM folded f JOIN parts s ON s.rid = f.rid AND s.k = f.k + 1
)
SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM placed p JOIN roots r ON r.tree = p.tree JOIN above t ON t.n = 1 LEFT JOIN proofs q ON q.rid = p.rid JOIN folded f ON f.rid = p.rid AND f.k = coalesce(q.steps, 0)
"""


@register
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = trie.turns_of(spark.read.parquet(f"{folder}/conversations.parquet"))
    base, kept = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % 6
    return trie.trie(*trie.forked(turns, base, kept, 6))


SQL["op13_prefix_trie"] = f"""
WITH RECURSIVE said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT conv_id AS id FROM said
), {_CRC}, plans AS (SELECT id, id - id % 100 AS base, v % 6 AS h FROM crc
), rebuilt AS (
  SELECT p.id, 0 AS part, s.i, s.role, s.text FROM plans p JOIN said s ON s.conv_id = p.base AND s.i < p.h
  UNION ALL SELECT p.id, 1, s.i, s.role, s.text FROM plans p JOIN said s ON s.conv_id = p.id AND s.i >= p.h
), turns AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, i) AS d, count(*) OVER (PARTITION BY id) AS n, length(text) AS chars,
    sha256(octet_length(encode(role))::VARCHAR || ':' || role || text) AS mark FROM rebuilt
), paths(id, d, n, chars, above, path) AS (
  SELECT id, d, n, chars, '', mark FROM turns WHERE d = 1
  UNION ALL SELECT p.id, t.d, t.n, t.chars, p.path, sha256(p.path || t.mark) FROM paths p JOIN turns t ON t.id = p.id AND t.d = p.d + 1
), rows_ AS (
  SELECT id, d, n, chars, above, path FROM paths
  UNION ALL SELECT i.id, 0, coalesce((SELECT max(n) FROM turns t WHERE t.id = i.id), 0), 0, NULL, '' FROM ids i
), nodes AS (
  SELECT d, path, any_value(above) AS above, min(id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (d = n), '')) AS ends FROM rows_ GROUP BY d, path
), children AS (SELECT d - 1 AS d, above AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), full_ AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.path = n.path
), below(d, path, leaf, saved, up_d, up_path) AS (
  SELECT d, path, CAST(n_children = 0 AS BIGINT), saved, d, path FROM full_
  UNION ALL SELECT b.d, b.path, b.leaf, b.saved, f.d - 1, f.above FROM below b JOIN full_ f ON f.d = b.up_d AND f.path = b.up_path WHERE f.d > 0
), sums AS (SELECT up_d AS d, up_path AS path, sum(leaf) AS n_leaves, sum(saved) AS saved FROM below GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_ f JOIN sums s ON s.d = f.d AND s.path = f.path LEFT JOIN nodes p ON p.d = f.d - 1 AND p.path = f.above
"""
