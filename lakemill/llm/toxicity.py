"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import common

#: Hashed terms: 2 to this power.
BITS = 20
#: Labelled documents of each class that the model is fitted on at most, chosen by a hash of doc_id.
FIT_ROWS = 3000
#: Terms that enter the machine for themselves at most: those whose document frequencies in the two classes differ most.
TERMS = 1024
#: Terms that enter it for a pair that tells more than either of its terms, at most, and of how many the pairs are counted.
PAIR_TERMS = 64
PAIRED = 3072
RANK = 4
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W\d_]+")
#: Besides each word, its first letters are terms, which are shared by inflected forms.
STEMS = (4, 5, 6)
#: Words whose terms a worker remembers.
CACHE = 400_000


class Terms(dict):
    """The hashed terms of a word: the word itself and its stems."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        found = {word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)}
        self[word] = out = tuple(xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) >> (32 - BITS) for w in found)
        return out


_TERMS = Terms()
common.CACHES["terms"] = _TERMS.clear


def hashed(text: str | None) -> set[int]:
    return set().union(*map(_TERMS.__getitem__, set(WORDS.findall((text or "").lower()))))


@dataclass
class Machine:
    """p = logistic(bias + sum of weights + pairwise products of factors) over the kept terms that a text has."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """``x`` holds 0 or 1 for each text and kept term."""
        crossed = x @ self.factor
        return self.bias + x @ self.weight + 0.5 * (crossed**2 - x @ (self.factor**2)).sum(axis=1)


def apart(toxic: np.ndarray, clean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sample z scores, without sign, of counts among ``n`` (clean, toxic) documents."""
    both = (toxic + clean) / n.sum()
    return np.abs(toxic / n[1] - clean / n[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))


def clear_terms(flat: np.ndarray, lengths: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
    """The terms with the highest z score of document frequency, at least 3.

    ``flat`` holds the distinct terms of one document after the other, ``lengths`` how many each has.
    """
    of = np.repeat(y, lengths)
    counts = [np.bincount(flat[of == k], minlength=1 << BITS).astype(np.float64) for k in (0, 1)]
    z = apart(counts[1], counts[0], np.maximum(np.bincount(y, minlength=2), 1))
    seen = np.flatnonzero((counts[0] + counts[1] >= 5) & (z >= 3))
    return np.sort(seen[np.lexsort((seen, -z[seen]))][:terms])


def pair_terms(flat: np.ndarray, lengths: np.ndarray, y: np.ndarray, terms: int = PAIR_TERMS, paired: int = PAIRED) -> np.ndarray:
    """The terms of the pairs that tell the classes apart more clearly than either term alone.

    Of the ``paired`` most frequent terms, all pairs' documents are counted by one matrix product for each class. A
    pair in ten documents at least counts if its z score is at least 6, and 3 above those of both its terms.
    """
    n = np.bincount(flat, minlength=1 << BITS)
    among = np.flatnonzero((n >= 10) & (n <= 0.9 * max(len(y), 1)))
    among = np.sort(among[np.lexsort((among, -n[among]))][:paired])
    x = indicator(flat, lengths, among, np.float32)
    counts = [x[y == k].T @ x[y == k] for k in (0, 1)]
    z = apart(counts[1], counts[0], np.maximum(np.bincount(y, minlength=2), 1).astype(np.float32))
    alone = np.diag(z).copy()
    z[(counts[0] + counts[1] < 10) | (z < 6) | (z < 3 + np.maximum(alone[:, None], alone[None, :]))] = 0
    best = z.max(axis=1, initial=0)
    order = np.lexsort((among, -best))
    return among[order[best[order] > 0][:terms]]


def indicator(flat: np.ndarray, lengths: np.ndarray, kept: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Documents x kept terms, 1 where the document has the term."""
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    column, row = place[flat], np.repeat(np.arange(len(lengths)), lengths)
    x = np.zeros((len(lengths), len(kept)), kind)
    x[row[column >= 0], column[column >= 0]] = 1
    return x


def fit(flat: np.ndarray, lengths: np.ndarray, y: np.ndarray, prior: float, terms: int = TERMS, rank: int = RANK, steps: int = 400, seed: int = 0) -> Machine:
    """Logistic loss with small ridge, full batches, Adam; rows are weighed so that the classes have their ``prior``."""
    kept = np.union1d(clear_terms(flat, lengths, y, terms), pair_terms(flat, lengths, y))
    x = indicator(flat, lengths, kept)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    share = np.maximum(np.bincount(y, minlength=2) / max(len(y), 1), 1e-9)
    weigh = np.where(y == 1, prior / share[1], (1 - prior) / share[0])
    rng = np.random.default_rng(seed)
    theta = [np.array([np.log(prior / (1 - prior))]), np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), rank))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1 if len(y) else 1):
        bias, w, v = theta
        crossed = x @ v
        margin = bias[0] + x @ w + 0.5 * (crossed**2 - x @ (v**2)).sum(axis=1)
        slope = weigh * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        back = x.T @ slope
        grads = [np.array([slope.sum()]), back + 1e-4 * w, x.T @ (slope[:, None] * crossed) - back[:, None] * v + 1e-3 * v]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            theta[k] = theta[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(kept, float(theta[0][0]), theta[1], theta[2])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **how: int) -> Machine:
    """Fits the machine on at most ``fit_rows`` labelled documents of each class, never on held-out ones.

    Rows are chosen by a hash of doc_id. A document with contradicting labels counts as toxic; a label without a
    document, or a null label, counts for nothing. Only the chosen rows' distinct hashed terms come to the driver, at
    most 2 ** BITS of each of 2 * fit_rows documents.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    by_doc = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    by_doc = by_doc.withColumn("draw", F.xxhash64("doc_id"))
    counts = dict(by_doc.groupBy("toxic").count().collect())
    chosen = [by_doc.where(F.col("toxic") == k).orderBy("draw", "doc_id").limit(fit_rows) for k in (0, 1)]
    chosen = common.cut(chosen[0].unionAll(chosen[1]), "fit")  # 2 * fit_rows rows of three numbers at most

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(hashed(x.as_py())) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.list_(pa.int32()))], ["doc_id", "toxic", "draw", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    found = rows.select("doc_id", "toxic", F.xxhash64("text").alias("draw"), "text").mapInArrow(common.task("terms", terms), "doc_id long, toxic int, draw long, terms array<int>")
    # of texts that share a doc_id, the one with the least hash is taken, so that reruns agree
    found = found.groupBy("doc_id", "toxic").agg(F.min(F.struct("draw", "terms")).alias("least")).select("doc_id", "toxic", "least.terms")
    found = found.toArrow().combine_chunks().sort_by("doc_id")
    lists, n = found["terms"].combine_chunks(), sum(counts.values())
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return fit(lists.flatten().to_numpy(zero_copy_only=False), lengths, found["toxic"].to_numpy().astype(np.int64), counts.get(1, 0) / n if n else 0.5, **how)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Scores every document of ``docs`` (doc_id, text) by itself; nothing is shuffled.

    Defined results: a null or empty text, or one without a kept term, has the bias's score; a text is read whole
    whatever its length; repeated rows give equal rows; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((machine.terms, machine.bias, machine.weight, machine.factor))  # at most TERMS + PAIR_TERMS of each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Machine(*shared.value)
        kept = model.terms
        wanted = set(kept.tolist())
        known: dict[str, tuple[int, ...]] = {}

        def of(word: str) -> tuple[int, ...]:
            if (found := known.get(word)) is None:
                if len(known) >= CACHE:
                    known.clear()
                known[word] = found = tuple(t for t in _TERMS[word] if t in wanted)
            return found

        for frame in batches:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                sets = [{t for w in set(WORDS.findall((x or "").lower())) for t in of(w)} for x in part["text"]]
                flat = np.fromiter((t for s in sets for t in s), np.int64)
                x = indicator(flat, np.array([len(s) for s in sets]), kept)
                p = 1 / (1 + np.exp(-np.clip(model.margins(x), -30, 30)))
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": p, "predicted": (p >= threshold).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(common.task("terms", run), "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, learn(docs, common.table(spark, sf_dir, "labels")))
