"""Operator 5: document quality by hierarchical empirical Bayes. A classifier's evidence for each document is combined
with posteriors of its host and path, which shrink towards global rates where a site has few documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import KEY, join_counted, materialize, row_key, small, without

#: Labelled documents that the classifier is fitted on at most: those with the smallest hashes of their ids.
TRAINING_ROWS = 12_000
#: Hash buckets of words. A word counts if the labelled documents with and without a label differ in how many have it by
#: this many standard errors.
BUCKETS, LEAST_ERRORS = 1 << 19, 6.0
#: A document is rejected when the chance that it is of low quality, or that it is toxic, is at least this.
REJECT = 0.5

_CLASS = np.full(256, 7, np.uint8)  # other signs
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[np.flatnonzero(words.SPACE)] = 3
_CLASS[[ord(c) for c in "#$%&*"]] = 4
_CLASS[ord("!")], _CLASS[ord("|")] = 5, 6
#: Letters and digits in lower case; all other ASCII becomes space.
_PLAIN = bytes((c if (chr(c).isalnum() or c > 127) else 32) for c in bytes(range(256)).lower())
_SURFACE = 13


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, word buckets, surface): each text's different words by bucket, and its figures: the logarithms of
    its length and words, shares of kinds of bytes, length of words, shares of different words, of the commonest word
    and of different lines."""
    n = len(texts)
    found = words.split([t.translate(_PLAIN) for t in texts])
    doc, value = found.texts(), found.hashes() & np.uint64((1 << 44) - 1)
    both, count = np.unique((doc.astype(np.uint64) << np.uint64(44)) | value, return_counts=True)
    owner, bucket = (both >> np.uint64(44)).astype(np.int64), (both & np.uint64(BUCKETS - 1)).astype(np.int64)
    size = np.array([len(t) for t in texts])
    kinds = np.bincount(np.repeat(np.arange(n), size) * 8 + _CLASS[np.frombuffer(b"".join(texts), np.uint8)], minlength=8 * n).reshape(n, 8)
    n_words, different = np.diff(found.first), np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    lines = [t.split(b"\n") for t in texts]
    line_share = np.array([len(set(x)) / len(x) for x in lines]) if n else np.zeros(0)
    least = np.maximum(n_words, 1)
    surface = np.column_stack([np.log1p(size), np.log1p(n_words), kinds / np.maximum(size, 1)[:, None], size / least / 10, different / least, top / least + line_share - 1])
    return owner, bucket, surface


@dataclass
class Classifier:
    """Logistic regression over words present and surface figures; one column for each label."""

    word: np.ndarray
    surface: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, texts: list[bytes]) -> np.ndarray:
        owner, bucket, surface = features(texts)
        out = np.clip((surface - self.mean) / self.scale, -8, 8) @ self.surface + self.bias
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(owner, self.word[bucket, k], len(texts))
        return out


def fit(found: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 12, seed: int = 7) -> Classifier:
    """Adagrad over small batches, of the words that tell labels apart."""
    n, heads = labels.shape
    surface = np.array([s for _, s in found]).reshape(n, _SURFACE)
    mean, scale = (surface.mean(axis=0), surface.std(axis=0) + 1e-6) if n else (np.zeros(_SURFACE), np.ones(_SURFACE))
    surface = np.clip((surface - mean) / scale, -8, 8)
    telling = np.zeros(BUCKETS, bool)
    for k in range(heads):
        have = np.zeros((2, BUCKETS))
        for (b, _), label in zip(found, labels[:, k], strict=True):
            have[int(label), b] += 1
        with_, without = labels[:, k].sum(), n - labels[:, k].sum()
        share = have.sum(axis=0) / max(n, 1)
        error = np.sqrt(share * (1 - share) * (1 / max(with_, 1) + 1 / max(without, 1))) + 1e-9
        telling |= np.abs(have[1] / max(with_, 1) - have[0] / max(without, 1)) >= LEAST_ERRORS * error
    rows = [b[telling[b]] for b, _ in found]
    word, flat, rng = np.zeros((BUCKETS, heads), np.float32), np.zeros((_SURFACE + 1, heads)), np.random.default_rng(seed)
    rate = (labels.mean(axis=0) if n else np.zeros(heads)).clip(1e-3, 1 - 1e-3)
    flat[-1] = np.log(rate / (1 - rate))
    word_g, flat_g = np.full((BUCKETS, heads), 1.0, np.float32), np.full((_SURFACE + 1, heads), 1.0)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(n), max(1, n // 64)) if n else []:
            owner, own = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part]), np.concatenate([rows[i] for i in part])
            x = np.column_stack([surface[part], np.ones(len(part))])
            z = x @ flat
            for k in range(heads):
                z[:, k] += np.bincount(owner, word[own, k], len(part))
            miss = 1 / (1 + np.exp(-z.clip(-30, 30))) - labels[part]
            used, code = np.unique(own, return_inverse=True)
            for k in range(heads):
                g = np.bincount(code, miss[owner, k], len(used)) + 3e-3 * word[used, k]
                word_g[used, k] += g**2
                word[used, k] -= 0.6 * g / np.sqrt(word_g[used, k])
            g = x.T @ miss + 1e-3 * flat
            flat_g += g**2
            flat -= 0.15 * g / np.sqrt(flat_g)
    return Classifier(word, flat[:-1], flat[-1], mean, scale)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Classifier:
    """Fitted on at most so many labelled documents. Labels without doc_id or quality don't count, a null toxic is 0, and of
    labels for one doc_id the worst holds. Only the features of those documents come to the driver."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(
        (1 - F.min("quality")).alias("bad"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    known = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(most))  # bounded by most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, F.col("doc_id") == F.col("__id"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.chunks(batches, limit=1 << 20):
            owner, bucket, surface = features(texts)
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            got = [bucket[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "bad", "toxic"]).columns, pa.array(got, pa.binary()), pa.array([s.tobytes() for s in surface], pa.binary())], names=["doc_id", "bad", "toxic", "words", "surface"])

    got = rows.select("doc_id", F.col("bad").cast("int"), F.col("toxic").cast("int"), "text").mapInArrow(task, "doc_id long, bad int, toxic int, words binary, surface binary")
    # one row an id, so rows are at most most
    got = got.groupBy("doc_id").agg(F.min(F.struct("bad", "toxic", "words", "surface")).alias("r")).select("doc_id", "r.*")
    # copies of a text would make its words look telling, so each text counts once
    every = sorted((tuple(r) for r in got.toLocalIterator()), key=lambda r: (r[0], r[3]))
    got = list({r[3:]: r for r in reversed(every)}.values())[::-1]
    model = fit([(np.frombuffer(r[3], "<u4"), np.frombuffer(r[4])) for r in got], np.array([r[1:3] for r in got], float).reshape(-1, 2))
    del got, every
    words.give_back()
    return model


def evidence(docs: DataFrame, model: Classifier, host: Column, path: Column) -> DataFrame:
    """(doc_id, text_key, host, path, bad, toxic): the classifier's chances for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.chunks(batches, limit=1 << 20):
            chance = 1 / (1 + np.exp(-shared.value.logits(texts).clip(-30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(chance[:, 0]), pa.array(chance[:, 1])], names=["doc_id", "text_key", "host", "path", "bad", "toxic"])

    rows = docs.select(*row_key(), named(host).alias("host"), named(path).alias("path"), "text")
    return rows.mapInArrow(task, "doc_id long, text_key long, host string, path string, bad double, toxic double")


def _strength(n: Column, k: Column, prior: Column | float) -> list[Column]:
    """What the moments need: groups, documents, and the weighted squares of the groups' rates around the prior."""
    return [F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(n * (k / n - prior) ** 2).alias("ss"), F.sum(n * n).alias("nn")]


def _prior_weight(r, rate: float) -> float:
    """How many documents a prior of this rate is worth, from how far the groups' rates lie apart (by moments): a lot
    when they differ no more than chance lets them."""
    if not r or not r["n"] or r["g"] < 2:
        return 1e4
    within = rate * (1 - rate)
    between = (r["ss"] - (r["g"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(np.clip(within / between - 1 if between > 0 else 1e4, 1.0, 1e4))


def site_posteriors(scores: DataFrame) -> tuple[DataFrame, dict[str, float], dict[str, tuple[float, float]]]:
    """(host, path, n, bad, toxic, host_n, bad_host, toxic_host, bad_site, toxic_site) by grouped aggregation: counts and
    sums of chances of each path and its host, and the path's rate; with them the global rates, and how many documents
    the priors of hosts and of paths are worth. A host's rate is its documents' mean chance, shrunk towards the global
    rate; a path's is shrunk towards its host's."""
    kinds = ("bad", "toxic")
    paths = materialize(scores.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in kinds]), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(k).alias(f"{k}_host") for k in kinds]), "hosts")
    total = hosts.agg(F.sum("host_n").alias("n"), *[F.sum(f"{k}_host").alias(k) for k in kinds]).first()
    rates = {k: float(np.clip((total[k] or 0.0) / max(total["n"] or 0, 1), 1e-6, 1 - 1e-6)) for k in kinds}
    paths = materialize(paths.join(small(hosts), "host"), "paths")
    weights = {}
    for k in kinds:
        top = _prior_weight(hosts.agg(*_strength(F.col("host_n"), F.col(f"{k}_host"), F.lit(rates[k]))).first(), rates[k])
        host_rate = (F.col(f"{k}_host") + top * rates[k]) / (F.col("host_n") + top)
        weights[k] = top, _prior_weight(paths.agg(*_strength(F.col("n"), F.col(k), host_rate)).first(), rates[k])
        paths = paths.withColumn(f"{k}_site", (F.col(k) + weights[k][1] * host_rate) / (F.col("n") + weights[k][1]))
    return paths, rates, weights


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, reject: float = REJECT) -> DataFrame:
    """One row per document: doc_id, text_key, host, path, document_bad, site_bad, p_bad, document_toxic, site_toxic,
    p_toxic, kept.

    The odds of a document are the classifier's times how its path's rate differs in odds from the global rate. The
    rates of its host and path are those of their other documents, so its own evidence counts once. kept is
    false when p_bad or p_toxic reaches reject. Null and empty texts are judged by their figures, texts of any length
    as a whole; a null host or path is a site of that name "". Repeated rows are judged each, alike. Without any usable
    label all is kept. An empty table gives an empty one. Other columns are ignored."""
    scores = materialize(evidence(docs, train(docs, labels), host, path), "evidence")
    sites, rates, weights = site_posteriors(scores)
    sites = materialize(sites.select("host", "path", "n", "host_n", *[F.col(c).alias(f"__{c}") for c in ("bad", "toxic", "bad_host", "toxic_host")]), "sites")
    out = join_counted(scores, sites, ["host", "path"], "n", sites.agg(F.sum("n")).first()[0] or 0)
    odds = lambda p: F.log(p / (1 - p))
    bounded = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-9)), F.lit(1 - 1e-9))
    for k in ("bad", "toxic"):
        top, low = weights[k]
        host_rate = (F.col(f"__{k}_host") - F.col(k) + top * rates[k]) / (F.col("host_n") - 1 + top)
        out = out.withColumn(f"{k}_site", (F.col(f"__{k}") - F.col(k) + low * host_rate) / (F.col("n") - 1 + low))
        z = odds(bounded(k)) + odds(bounded(f"{k}_site")) - F.lit(float(np.log(rates[k] / (1 - rates[k]))))
        out = out.withColumn(f"p_{k}", 1 / (1 + F.exp(-z)))
    kept = (F.col("p_bad") < reject) & (F.col("p_toxic") < reject)
    return out.select(*KEY, "host", "path", F.col("bad").alias("document_bad"), F.col("bad_site").alias("site_bad"), "p_bad", F.col("toxic").alias("document_toxic"), F.col("toxic_site").alias("site_toxic"), "p_toxic", kept.alias("kept"))


def drop_rejected(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """docs without those that judge rejects, all columns kept."""
    return without(docs, judge(docs, labels, host, path).where("NOT kept"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """The host of a document is its source; the path below it is the language."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels, F.col("source"), F.col("lang")).drop("text_key")
