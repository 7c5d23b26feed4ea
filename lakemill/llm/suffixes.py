"""Repeated passages by sparse suffixes: those at minimisers are sorted, compared with their neighbours and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm import common
from lakemill.llm.jaccard import _mix, gram_hashes, word_hashes

#: Words of the shortest passage that is found.
PASSAGE = 50
#: Words of the grams that minimisers are chosen from.
GRAM = 8
#: Bits of the map of repeated anchors, 2 to this power.
MAP_BITS = 24
#: Runs whose minimisers are selected at once.
BLOCK = 1 << 16
#: Bytes of results that a task holds before it hands them on, about.
HELD = 8_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; a worker keeps the longest it needed, up to a bound."""
    have = _POWERS.get(base, np.empty(0, np.uint64))
    if len(have) < n:
        have = np.full(max(n, 1 << 15), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 20:
            _POWERS[base] = have
    return have[:n]


def passage_hashes(words: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each of ``lengths`` a hash of every run of so many words, from differences of one cumulative polynomial."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(_INVERSE, len(words)), dtype=np.uint64)])
    return [_mix((total[n:] - total[:-n]) * _powers(_BASE, len(words) - n + 1)) for n in lengths]


def window_of(length: int, gram: int) -> int:
    """Grams among which a minimiser is selected: half of a passage's, so that more than half a passage follows it."""
    return max(1, (length - gram + 1) // 2)


def selected(words: np.ndarray, length: int = PASSAGE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The selected places of a text, for each its first run of ``length`` words, and the one past its last.

    Every run selects the smallest of its first ``window_of`` grams, the leftmost of equal ones; neighbours share it.
    So equal runs select the same place, whatever stands around them.
    """
    grams = gram_hashes(words, gram)
    runs, width = len(words) - length + 1, window_of(length, gram)
    at = np.empty(runs, np.int64)
    for i in range(0, runs, BLOCK):
        part = np.lib.stride_tricks.sliding_window_view(grams[i : i + BLOCK + width - 1], width)[: runs - i]
        at[i : i + len(part)] = part.argmin(axis=1) + np.arange(i, i + len(part))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], runs)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def repeated_anchors(docs: DataFrame, length: int = PASSAGE, gram: int = GRAM) -> np.ndarray:
    """A bitmap of the beginnings of suffixes that stand at more than one place of the corpus."""
    sure = length - window_of(length, gram) + 1

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [np.empty(0, np.uint64)], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["anchor"])
        for batch in batches:
            for raw in batch.column(0):
                words = word_hashes(raw.as_py() or b"")
                if len(words) >= length:
                    at, _, _ = selected(words, length, gram)
                    out.append(passage_hashes(words, sure)[0][at])
                    held += out[-1].nbytes
                if held > HELD:
                    yield done()
                    out, held = [np.empty(0, np.uint64)], 0
        yield done()

    keys = _texts(docs).select("text").mapInArrow(common.task("words", select), "anchor long")
    return bitmap(keys.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))


def bitmap(anchors: DataFrame) -> np.ndarray:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MAP_BITS, bool)
        for batch in batches:
            bits[_place(batch.column(0).to_numpy().view(np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], ["bits"])

    return common.tree_merge(anchors.mapInArrow(common.task("words", mark), "bits binary"), "u1", (1 << MAP_BITS) // 8, np.bitwise_or)


def _place(anchor: np.ndarray) -> np.ndarray:
    return anchor >> np.uint64(64 - MAP_BITS)


def suffixes(docs: DataFrame, length: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(anchor, block, row, doc_id, at, runs, hashes): the suffixes at minimisers whose beginnings the corpus repeats.

    ``anchor`` stands for the words that follow a selected place in every run that selects it. From ``at`` on there
    are ``runs`` such runs: ``hashes`` has the content of each, ``block`` of them all. A repeated run has its place at
    the same word in each copy, so it is kept with all its copies; a suffix that begins like no other is dropped in
    its task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs, length, gram))  # 2 ** MAP_BITS bits
    sure, names = length - window_of(length, gram) + 1, ["anchor", "block", "row", "doc_id", "at", "runs", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        cols: list[list] = [[] for _ in names]
        held = 0

        def done() -> pa.RecordBatch:
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in cols[:3] + cols[4:]]
            arrays = [pa.array(x.view(np.int64)) for x in flat[:3]] + [pa.array(cols[3], pa.int64())] + [pa.array(x.view(np.int64)) for x in flat[3:5]]
            ends = np.concatenate([[0], np.cumsum(flat[4])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[5].view(np.int64)))], names)

        for batch in batches:
            for row, doc, raw in zip(*batch.columns, strict=True):
                words = word_hashes(raw.as_py() or b"")
                if len(words) < length:
                    continue
                at, first, end = selected(words, length, gram)
                begins, content = passage_hashes(words, sure, length)
                key = begins[at]
                place = _place(key).astype(np.int64)
                kept = np.flatnonzero((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
                if not len(kept):
                    continue
                key, first, end = key[kept], first[kept], end[kept]
                runs = end - first
                inside = np.arange(runs.sum()) + np.repeat(first - np.cumsum(runs) + runs, runs)
                block = _mix(_mix(content[first]) + content[end - 1] + runs.astype(np.uint64))
                for col, x in zip(cols, (key, block, np.full(len(kept), row.as_py()), [doc.as_py()] * len(kept), first, runs, content[inside]), strict=True):
                    col.extend(x) if isinstance(x, list) else col.append(x)
                held += 48 * len(kept) + 8 * len(inside)
                if held > HELD:
                    yield done()
                    cols, held = [[] for _ in names], 0
        yield done()

    return _texts(docs).mapInArrow(common.task("words", run), "anchor long, block long, row long, doc_id long, at long, runs long, hashes array<long>")


def neighbours(runs: DataFrame) -> DataFrame:
    """Adds ``before`` and ``after`` to (hash, doc_id, row, place, n, ...): whether those next to each in the order of them all are alike.

    Runs are sorted over all tasks by content, then place; the key is unique, so that copies of a common run spread
    over as many tasks as they fill. Each is compared in the task that sorts it, and one that is like neither neighbour
    and stands for itself (``n``) goes no further. Each task tells its neighbours its first and last content, two
    numbers a task.
    """
    order = ["hash", "doc_id", "row", "place"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, alike = None, None  # a batch, and whether its first run is like the one before: none, at a task's first

        def told(after: bool | None) -> pa.RecordBatch:
            key = held.column("hash").to_numpy()
            inside = (key[1:] == key[:-1]).tolist()
            own = pa.RecordBatch.from_arrays([*held.columns, pa.array([alike, *inside], pa.bool_()), pa.array([*inside, after], pa.bool_())], [*held.schema.names, "before", "after"])
            edges = [own.column(c).fill_null(True).to_numpy(zero_copy_only=False) for c in ("before", "after")]
            return own.filter(pa.array(edges[0] | edges[1] | (held.column("n").to_numpy() > 1)))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                same = held.column("hash")[-1].as_py() == batch.column("hash")[0].as_py()
                yield told(same)
                alike = same
            held = batch
        if held is not None:
            yield told(None)

    schema = ", ".join(f"{c} {t}" for c, t in runs.dtypes)
    dealt = runs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(common.task("words", compare), f"{schema}, before boolean, after boolean")
    dealt = common.cut(dealt.withColumn("part", F.spark_partition_id()), "sorted")
    by_part = W.orderBy("part")
    edges = dealt.groupBy("part").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    edges = edges.select("part", F.lag("high").over(by_part).alias("outer_before"), F.lead("low").over(by_part).alias("outer_after"))
    found = dealt.join(F.broadcast(edges), "part")  # one row a partition
    at_edge = lambda c: F.coalesce(c, F.col("hash") == F.col(f"outer_{c}"), F.lit(False))
    return found.withColumns({c: at_edge(c) for c in ("before", "after")}).drop("part", "outer_before", "outer_after")


def _matches(found: DataFrame) -> DataFrame:
    """(anchor, block, n, row, at, repeated, earliest): masks of the runs that have a copy, and of the earliest copies.

    Suffixes that are wholly alike are counted as one, with the earliest place. Where an anchor has one kind of suffix
    only, that decides; else each run of one suffix of each kind is compared with its neighbours. So no step gathers
    the copies of a common passage, nor the suffixes that begin with it. What a run's suffix is goes by its place, and
    is joined to the masks again: there are many more runs than suffixes.
    """
    blocks = found.groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "at")).alias("least"), F.first("runs").alias("runs"))
    blocks = common.cut(blocks.select("anchor", "block", "n", "least.doc_id", "least.row", "least.at", "runs"), "blocks")
    common.release(found.sparkSession)
    several = common.bit_table(blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor"))
    blocks = common.maybe_in(blocks, F.col("anchor"), several, "several")
    bit = lambda c: F.expr(f"shiftleft(1L, CAST({c} AS INT))")
    alike = blocks.where("NOT several AND n > 1").withColumn("repeated", bit("runs") - 1)
    alike = alike.select("anchor", "block", "n", "row", "at", "repeated", F.col("repeated").alias("earliest"))
    kinds = common.cut(blocks.where("several").select("anchor", "block", "n", "row", "at"), "kinds")
    place = F.xxhash64("row", "at")
    marked = common.bit_table(kinds.select(place))
    one = common.maybe_in(found.select("row", "doc_id", "at", "hashes"), place, marked, "marked").where("marked").drop("marked")
    runs = one.join(kinds.select("n", "row", "at"), ["row", "at"]).select("n", "doc_id", "row", "at", F.posexplode("hashes").alias("offset", "hash"))
    runs = neighbours(runs.withColumn("place", F.col("at") + F.col("offset")))
    common.release(found.sparkSession)
    copied = (F.col("n") > 1) | F.col("before") | F.col("after")
    hit = runs.where(copied).withColumns({"bit": bit("offset"), "opens": ~F.col("before")})
    masks = hit.groupBy("row", "at").agg(F.bit_or("bit").alias("repeated"), F.bit_or(F.when(F.col("opens"), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("earliest"))
    masks = kinds.join(masks, ["row", "at"]).select("anchor", "block", "n", "row", "at", "repeated", "earliest")
    return common.cut(alike.unionAll(masks), "masks")


def _ranges(matched: DataFrame) -> DataFrame:
    """(row, doc_id, first, at, end): the runs of (row, doc_id, at, repeated, earliest) in a row, by the masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, repeated, earliest = (batch.column(c).to_numpy() for c in ("at", "repeated", "earliest"))
            out = []
            for first, mask in ((True, earliest), (False, repeated & ~earliest)):
                bits = ((mask[:, None] >> np.arange(63)) & 1).astype(np.int8)
                edge = np.diff(bits, axis=1, prepend=0, append=0)
                row, start = np.nonzero(edge == 1)
                out.append((row, np.full(len(row), first), at[row] + start, at[row] + np.nonzero(edge == -1)[1]))
            row, first, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
            own = [batch.column(c).take(pa.array(row)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first), pa.array(start), pa.array(end)], ["row", "doc_id", "first", "at", "end"])

    return matched.select("row", "doc_id", "at", "repeated", "earliest").mapInArrow(common.task("words", run), "row long, doc_id long, first boolean, at long, end long")


@common.tidy
def repeats(docs: DataFrame, length: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """The passages of at least ``length`` words that occur more than once in ``docs`` (doc_id, text).

    Of all suffixes, those at minimisers of word grams are retained. A suffix that begins like no other is dropped;
    the others are put together by content, and where those that begin alike go on or begin differently, every run of
    ``length`` words around their minimiser is sorted with all others and compared with its neighbours. Matches are
    then extended: those that overlap or touch, to the left or to the right, are one passage. Words are compared by
    64-bit hashes of their runs.

    Rows: doc_id, start_word, end_word (exclusive), n_words, first. ``first`` passages hold the earliest copy, by
    doc_id and place, of each of their runs; the others are the ones to remove. Words end at ASCII white space and
    A-Z are lower-cased.

    Defined results: null, empty and short texts have none; a passage that a document repeats within itself counts;
    rows that share a doc_id, or have none, are documents of their own that repeat each other; a null doc_id comes
    before all others; an empty table gives no rows; other columns are ignored.
    """
    found = common.cut(suffixes(docs, length, gram), "suffixes")
    common.release(docs.sparkSession)
    masks = _matches(found)
    common.release(docs.sparkSession)
    told = masks.select("anchor", "block", "n", F.col("row").alias("least_row"), F.col("at").alias("least_at"), "repeated", "earliest")
    dealt = common.hot_join(found.select("anchor", "block", "row", "doc_id", "at"), told, ["anchor", "block"], "n", "row", "at")
    mine = (F.col("row") == F.col("least_row")) & (F.col("at") == F.col("least_at"))
    matched = dealt.withColumn("earliest", F.when(mine, F.col("earliest")).otherwise(F.lit(0).cast("long")))
    by_place = W.partitionBy("row", "first").orderBy("at")
    before = F.lag("end").over(by_place) - 1
    numbered = _ranges(matched).withColumn("opens", F.coalesce(F.col("at") > before + length, F.lit(True)).cast("int"))
    numbered = numbered.withColumn("passage", F.sum("opens").over(by_place.rowsBetween(W.unboundedPreceding, 0)))
    spans = numbered.groupBy("row", "first", "passage").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("start_word"), (F.max("end") - 1 + length).alias("end_word"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.table(spark, sf_dir, "documents"))
