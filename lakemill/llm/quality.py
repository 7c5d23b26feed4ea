"""Document quality: a classifier's evidence on top of host and path posteriors, shrunk by empirical Bayes."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import common

#: Labelled documents of each class that the classifier is fitted on at most, chosen by a hash of doc_id.
FIT_ROWS = 3000
THRESHOLD = 0.5
#: Sites that are sent to all tasks at most.
SITES = 50_000
#: Ridge of the classifier, in units of standardised features.
RIDGE = 1e-3
#: Margins beyond this are as sure as any.
SURE = 12.0

UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
ENDS, SYMBOLS = b".,;:?'\"()", b"!#$%&*+/<=>@[\\]^_`{|}~-"
FEATURES = ("log_words", "word_bytes", "upper", "lower", "digits", "ends", "symbols", "bang", "bar", "repeated_words", "distinct_words", "log_lines", "distinct_lines", "longest_word")


def distinct_share(words: list[bytes]) -> float:
    """The share of distinct words in blocks of 256, over all words, so that it does not fall with the length."""
    return sum(len(set(words[k : k + 256])) for k in range(0, len(words), 256)) / max(len(words), 1)


def features(raw: bytes) -> list[float]:
    """Shares of a UTF-8 text's bytes, words and lines; all are defined for an empty text."""
    n = max(len(raw), 1)
    share = lambda some: (len(raw) - len(raw.translate(None, some))) / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, k = max(len(words), 1), max(len(lines), 1)
    return [
        np.log1p(len(words)), len(raw) / w, share(UPPER), share(LOWER), share(DIGITS), share(ENDS), share(SYMBOLS), raw.count(b"!") / n, raw.count(b"|") / n,
        sum(map(operator.eq, words, words[1:])) / w, distinct_share(words), np.log1p(len(lines)), len(set(lines)) / k, np.log1p(max(map(len, words), default=0)),
    ]


@dataclass
class Classifier:
    """A logistic regression on standardised features; ``base`` is the log odds of its training prior."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    base: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratios of good against bad: log odds without those of the prior."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weight + self.bias, -SURE, SURE) - self.base


def fit(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Newton's method with a small ridge; one class alone gives no evidence."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    none = Classifier(mean, scale, np.zeros(x.shape[1]), 0.0, 0.0)
    if len(np.unique(y)) < 2:
        return none
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    theta, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], RIDGE * len(x))
    ridge[-1] = 1e-9
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(ridge), z.T @ (y - p) - ridge * theta)
        theta += step
        if np.abs(step).max() < 1e-8:
            break
    rate = y.mean()
    return Classifier(mean, scale, theta[:-1], float(theta[-1]), float(np.log(rate / (1 - rate))))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Classifier, float]:
    """The classifier, from at most ``fit_rows`` documents of each class, and the share of good ones of all labels.

    A document with contradicting labels counts as bad; null labels and labels without a document count for nothing.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    by_doc = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))
    by_doc = by_doc.withColumn("draw", F.xxhash64("doc_id"))
    counts = dict(by_doc.groupBy("good").count().collect())
    chosen = [by_doc.where(F.col("good") == k).orderBy("draw", "doc_id").limit(fit_rows) for k in (0, 1)]
    chosen = common.cut(chosen[0].unionAll(chosen[1]), "fit")  # 2 * fit_rows rows of three numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(raw.as_py() or b"") for raw in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "good", "draw", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(F.broadcast(chosen.select("doc_id", "good")), "doc_id").select("doc_id", "good", F.xxhash64("text").alias("draw"), "text")
    # of texts that share a doc_id, the one with the least hash is taken, so that reruns agree
    found = rows.mapInArrow(common.task("none", run), "doc_id long, good int, draw long, x array<double>").groupBy("doc_id", "good").agg(F.min(F.struct("draw", "x")).alias("least"))
    found = found.select("doc_id", "good", "least.x").toPandas().sort_values("doc_id")
    rate = min(max(counts.get(1, 0) / max(sum(counts.values()), 1), 0.01), 0.99) if counts else 0.5
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(FEATURES))
    if not len(found):
        x = np.zeros((1, len(FEATURES)))
    return fit(x, found["good"].to_numpy(np.float64) if len(found) else np.ones(1)), rate


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def strength(rates: DataFrame) -> float:
    """How many documents a prior weighs, by the method of moments, from (n, good, prior) of each site.

    The squared distance of a site's share from its prior is prior * (1 - prior) / n by chance; what is beyond that
    is true variance between sites. Without any, sites are shrunk to their prior all but wholly.
    """
    chance = F.col("prior") * (1 - F.col("prior"))
    gap = (F.col("good") / F.col("n") - F.col("prior")) ** 2 * F.col("n")
    one = rates.where("n > 0").agg(F.sum(chance).alias("chance"), F.sum(gap).alias("gap"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"), F.sum(chance * F.col("n")).alias("spread")).first()
    if not one["sites"] or one["sites"] < 2 or one["n"] <= one["sites"]:
        return 1e6
    between = max((one["gap"] - one["chance"]) / one["n"], 0.0)
    within = one["spread"] / one["n"]
    return float(min(max(within / between - 1, 1.0), 1e6)) if between > 0 else 1e6


def _evidence(docs: DataFrame, classifier: Classifier, *keep: Column) -> DataFrame:
    """``keep`` and ``evidence`` for each document; a row is worked on by itself."""
    c = classifier
    kept = docs.select(*keep, F.col("text").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(raw.as_py() or b"") for raw in batch.column(batch.num_columns - 1)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(c.evidence(x), pa.float64())], [*batch.schema.names[:-1], "evidence"])

    return kept.mapInArrow(common.task("none", run), kept.drop("__text").withColumn("evidence", F.lit(0.0)).schema)


KEY = ("host", "no_host", "path", "no_path")


def _site(host: Column, path: Column) -> list[Column]:
    """Host and path without nulls, each with a flag that tells a null from an empty name."""
    named = lambda c, name: [F.coalesce(c.cast("string"), F.lit("")).alias(name), c.isNull().alias(f"no_{name}")]
    return [*named(host, "host"), *named(path, "path")]


def sites(scored: DataFrame, prior: float) -> tuple[DataFrame, float, float, float]:
    """(host, no_host, path, no_path, n, good, host_n, host_good) from those and ``evidence`` of all documents.

    ``good`` sums up each document's classifier probability. With it come the global rate and how many documents it
    weighs for a host, and a host's posterior for a path, as the variance between them tells. Sums over a path are
    aggregated before the shuffle and a host's are sums of its paths', so no host or path is gathered anywhere.
    """
    p = _logistic(F.col("evidence") + float(np.log(prior / (1 - prior))))
    paths = common.cut(scored.withColumn("p", p).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")), "paths")
    total = paths.agg(F.sum("n"), F.sum("good")).first()
    rate = min(max((total[1] + prior) / (total[0] + 1), 0.001), 0.999) if total[0] else prior
    hosts = common.cut(paths.groupBy(*KEY[:2]).agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.count(F.lit(1)).alias("paths")), "hosts")
    of_host = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good"), F.lit(rate).alias("prior")))
    found = common.cut(common.hot_join(paths, hosts, list(KEY[:2]), "paths", "path").drop("paths"), "sites")
    of_path = strength(found.select("n", "good", ((F.col("host_good") + of_host * rate) / (F.col("host_n") + of_host)).alias("prior")))
    return found, rate, of_host, of_path


def _posteriors(rate: float, base: float, of_host: float, of_path: float) -> tuple[Column, Column]:
    """Posteriors of a document's host and path by their other documents, as its own evidence comes on top of them.

    A sparse host is shrunk to the global rate and a sparse path to its host's posterior.
    """
    own = _logistic(F.col("evidence") + base)
    bound = lambda c: F.least(F.greatest(c, F.lit(0.001)), F.lit(0.999))
    host = bound((F.col("host_good") - own + of_host * rate) / (F.col("host_n") - 1 + of_host))
    return host, bound((F.col("good") - own + of_path * host) / (F.col("n") - 1 + of_path))


@common.tidy
def assess(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """For each document of ``docs``: doc, evidence, host and path posteriors, quality and keep.

    ``doc`` is the row itself. ``quality`` is the probability of a good document by the classifier's evidence with
    the path's posterior, by its other documents, as its prior; ``keep`` tells if it reaches ``threshold``. A path is
    named within its host. Up to SITES sites go to all tasks; more are joined, a hot one in many tasks.

    Defined results: a null or empty text has the features of no text; null hosts are one host and null paths one
    path of their host, other than empty names; repeated rows each count; without labels of both classes the evidence
    is 0 and every document has its site's prior; an empty table gives no rows; other columns stay in ``doc`` as they
    are.
    """
    classifier, prior = learn(docs, labels, fit_rows)
    site = _site(F.col(f"`{host}`"), F.col(f"`{path}`"))
    known, rate, of_host, of_path = sites(common.cut(_evidence(docs, classifier, *site), "evidence"), prior)
    scored = _evidence(docs, classifier, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *site)
    if known.count() <= SITES:
        scored = scored.join(F.broadcast(known), list(KEY))
    else:
        scored = common.hot_join(scored.withColumn("__row", F.monotonically_increasing_id()), known, list(KEY), "n", "__row")
    host_posterior, path_posterior = _posteriors(rate, float(np.log(prior / (1 - prior))), of_host, of_path)
    scored = scored.withColumn("host_posterior", host_posterior).withColumn("path_posterior", path_posterior)
    quality = _logistic(F.col("evidence") + _logit(F.col("path_posterior")))
    found = scored.withColumn("quality", quality).withColumn("keep", F.col("quality") >= threshold)
    return found.select("doc", "evidence", "host_posterior", "path_posterior", "quality", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, **how: object) -> DataFrame:
    """The documents that ``assess`` keeps, with their own columns; its defined results hold here too."""
    return assess(docs, labels, **how).where("keep").select("doc.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with what the decision to keep each rests on."""
    found = assess(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "evidence", "host_posterior", "path_posterior", "quality", "keep")
