"""Quality by hierarchical empirical Bayes: a document classifier's evidence, joined with what its site and path show.

A logistic model on the style of a text (shares of neighbouring character classes, length, variety of words, repeated
lines) gives each document its evidence.  Posteriors of the share of good documents are then found from the top down: the
global share over all documents; for each host the share of its documents, shrunk towards the global one; for each path
the share of its documents, shrunk towards its host's.  How strongly a level shrinks is estimated from the spread of its
shares (method of moments), so a site with few documents says little.  A document's posterior odds are its evidence
times the odds of its path against the global odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.llm.common import Powers, chunks, map_texts, table, words

SAMPLE = 6000  # labelled documents that the classifier is fitted on, at most
RIDGE = 1.0
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\v\f", ".", ",;:", "!?", "|", "'\"`", "-_/\\()[]{}<>=+", "#$%&*@^~"]
_CLASS = np.full(256, len(_GROUPS) + 1, np.int64)  # bytes of characters beyond ASCII
_CLASS[:128] = len(_GROUPS)  # control characters
for _k, _group in enumerate(_GROUPS):
    _CLASS[list(_group.encode())] = _k
_KINDS = len(_GROUPS) + 2
FEATURES = _KINDS * _KINDS + 4


def features(column: pa.Array, powers: Powers) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    out = []
    for first, end, units, at in chunks(column):
        n = end - first
        size = np.diff(at)
        row = np.repeat(np.arange(n), size)
        kind = _CLASS[units]
        pair = (row[:-1] * _KINDS + kind[:-1]) * _KINDS + kind[1:]
        counts = np.bincount(pair[row[:-1] == row[1:]] if len(row) else [], minlength=n * _KINDS * _KINDS).reshape(n, -1)
        shares = counts / np.maximum(size, 1)[:, None]
        hashes, starts = words(units, at, powers)
        n_words = np.diff(starts)
        word_row = np.repeat(np.arange(n), n_words)
        order = np.lexsort((hashes, word_row))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_row[order][1:] != word_row[order][:-1])
        distinct = np.bincount(word_row[order][new], minlength=n)
        more = np.stack([np.log1p(size), distinct / np.maximum(n_words, 1), np.log1p(size / np.maximum(n_words, 1)), np.log1p(n_words - distinct)], 1)
        out.append(np.concatenate([np.sqrt(shares), more], 1))
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept
    prior: float  # log odds of good among the rows fitted on

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def fit(x: np.ndarray, good: np.ndarray) -> Model:
    """Ridge logistic regression by Newton steps."""
    if not len(x) or good.min() == good.max():  # nothing to tell apart: no evidence
        n = x.shape[1]
        share = (good.sum() + 1) / (len(good) + 2)
        prior = float(np.log(share / (1 - share)))
        return Model(np.zeros(n), np.ones(n), np.append(np.zeros(n), prior), prior)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], RIDGE), 1e-6)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (good - p) - ridge * w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    share = good.mean()
    return Model(mean, scale, w, float(np.log(share / (1 - share))))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on at most ``sample`` labelled documents, picked by a hash of their ids."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(table(known, "labelled"), "doc_id")
    powers = Powers()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(0), powers).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), batch.column(1)], ["x", "good"])

    rows = map_texts(texts.select("text", "quality"), run, "x array<float>, good int").toPandas()
    x = np.stack(rows["x"].to_numpy()).astype(float) if len(rows) else np.zeros((0, FEATURES))
    return fit(x, rows["good"].to_numpy(float))


def evidence(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs and ``log_odds`` of each text (which is sent along if it is not among them)."""
    powers, sent = Powers(), [*keep, *(["text"] if "text" not in keep else [])]
    at = sent.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        odds = pa.array(model.log_odds(features(batch.column(at), powers)))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], odds], [*keep, "log_odds"])

    docs = docs.withColumn("text", F.col("text").cast("string")).select(*sent)
    return map_texts(docs, run, docs.select(*keep).schema.add("log_odds", "double"))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> Column:
    """Prior strength of a level by moments: mean * (1 - mean) / variance between its groups - 1, as a one-row query.

    ``groups`` has n, good and parent, the share that they are shrunk towards.
    """
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("parent"), 2))
    noise = F.sum(F.col("parent") * (1 - F.col("parent")))
    size = F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")
    between = (spread - noise) / F.greatest(size, F.lit(1.0))
    inside = F.avg(F.col("parent") * (1 - F.col("parent")))
    ratio = inside / F.greatest(between, F.lit(1e-6)) - 1
    return groups.agg(F.coalesce(F.least(F.greatest(ratio, F.lit(1.0)), F.lit(1e5)), F.lit(1.0)).alias("k"))


def posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, n, host_share, path_share, global_share) from (host, path, log_odds) of all documents.

    The counts of good documents are sums of the classifier's probabilities.
    """
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(1 / (1 + F.exp(-F.col("log_odds")))).alias("good"))
    paths = table(paths, "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    share = total["good"] / total["n"] if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("parent", F.lit(float(share)))
    k = _strength(hosts).first()["k"]
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + k * F.col("parent")) / (F.col("n") + k)).alias("host_share"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("parent", F.col("host_share"))
    k = _strength(paths).first()["k"]
    found = paths.select("host", "path", "n", "host_share", ((F.col("good") + k * F.col("parent")) / (F.col("n") + k)).alias("path_share"))
    return table(found.withColumn("global_share", F.lit(float(share))), "posteriors")


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: list[str], sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The columns ``keep`` of every row with log_odds, host_share, path_share, posterior and ``good``.

    A row without text is judged by its features like any other (empty); a null host or path is a site of its own;
    without labels of both kinds all evidence is equal and sites decide nothing, so every row is good; an empty table
    gives no rows.  Site and path tables are grouped sums, a row for each path.  Columns kept may have any names but
    those that begin with ``_q_`` and the ones added.
    """
    model = fitted(docs, labels, sample)
    named = docs.select(*dict.fromkeys([*keep, "text"]), host.cast("string").alias("_q_host"), path.cast("string").alias("_q_path"))
    scored = evidence(named, model, [*keep, "_q_host", "_q_path"])
    if "text" in keep:  # texts are not copied for the sums: the evidence is found again
        slim = evidence(named, model, ["_q_host", "_q_path"])
    else:
        slim = scored = table(scored, "scored")
    found = posteriors(slim.select(F.col("_q_host").alias("host"), F.col("_q_path").alias("path"), "log_odds"))
    found = found.select(*[F.col(c).alias(f"_q_{c}{'2' * (c in ('host', 'path'))}") for c in found.columns])
    on = F.col("_q_host").eqNullSafe(F.col("_q_host2")) & F.col("_q_path").eqNullSafe(F.col("_q_path2"))
    odds = F.col("log_odds") + _logit(F.col("_q_path_share")) - _logit(F.col("_q_global_share"))
    posterior = F.coalesce(1 / (1 + F.exp(-odds)), F.lit(0.5))
    return scored.join(found, on, "left").select(
        *keep, "log_odds", F.col("_q_host_share").alias("host_share"), F.col("_q_path_share").alias("path_share"),
        posterior.alias("posterior"), (posterior >= threshold).alias("good"),
    )
