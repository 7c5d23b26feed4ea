"""The corpus pipeline: each stage works on all documents that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import common, jaccard, mixing, packing, pii, quality


#: Tables that the stages run so far have left in the shared folder, by application.
_LEFT: dict[str, set[str]] = {}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    """A stage that first deletes what earlier stages have left, as their results are written; not what ``docs`` reads."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.ship(spark)
        left = _LEFT.setdefault(spark.sparkContext.applicationId, set())
        read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()}
        old = {path for path in left if path.rsplit("/", 1)[1] not in read}
        common.delete(spark, old)
        left -= old
        with common.tables_made() as made:
            found = work(spark, docs, sf_dir)
        left |= made
        return found

    return run


@_stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site's posterior hold for good; a null text is judged as an empty one.

    Repeated rows are each judged; an empty table stays empty; other columns are kept whatever their names.
    """
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies; null and empty texts are in no group.

    Rows that share a doc_id stay or go together and one without a doc_id stays; an empty table stays empty; other
    columns are kept whatever their names.
    """
    return jaccard.keep_first(docs, k=5, percent=80)


@_stage
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars is that of the new text, null for a null text.

    Repeated rows all stay; an empty table stays empty; other columns are kept whatever their names.
    """
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null sources are one source.

    A source without words is not taken; repeated rows each count; an empty table stays empty; other columns are kept
    whatever their names.
    """
    return mixing.mix(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents; a null or empty text is the end id alone, and repeated rows are packed each.

    An empty table gives no pieces; other columns are ignored.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each),
    ("PII", without_personal_data),
    ("mixing sources", mixed),
    ("packing", packed),
]

#: The stages hash, learn and tokenise, which SQL cannot express; a test holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again for the next."""
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            common.delete(spark, [f"{base}/{k - 1}"])
    return docs
