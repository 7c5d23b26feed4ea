"""Exact Jaccard join of word n-gram sets by T-occurrence search (DivideSkip)."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm import common

#: Sizes of sets go in bands, each at most this share of the next; it must be below the threshold.
BAND = 0.75
#: Parts that sets are cut into beyond those that must be, as a share of the shingles in which two that link may differ.
MORE_PARTS = 0.3
#: What stands in the place of a need for rows that connect sets within a task, and for signatures shared there.
MEMBER, SHARED, LEAD = -1, -2, -3
#: Signatures that a task merges at once.
MERGED = 1_000_000
#: Bits of the candidates' bitmap, 2 to this power.
MAP_BITS = 23
#: Shingles that one search task indexes at most, about; larger candidate groups are cut into chunks.
BLOCK_SHINGLES = 250_000
#: Times that groups too large for one task are cut by their rare shingles before their chunks are paired.
ROUNDS = 3
#: Share of such groups that a round must leave over, at most, for another one to follow.
WORTH = 0.7
#: Sets of such a group that are searched with each of its chunks, so that most of a true cluster is found at once.
LEADERS = 8
#: Shingles that one batch of search tasks is sent, as a share of those of all sets, and at least.
SENT_SHARE, SENT_LEAST = 0.5, 4_000_000
#: Sets whose shingles become rows at once.
SENT_ROWS = 100
#: Small candidate groups are put together into tasks of about this share of a block.
TASK_SHARE = 4
#: Bytes of results that a task holds before it hands them on, about.
HELD = 16_000_000
#: Words whose hashes a worker remembers.
CACHE = 100_000


class WordHashes(dict):
    """64-bit hashes of words; two generations bound the memory."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict[bytes, int] = {}

    def empty(self) -> None:
        self.clear()
        self.older.clear()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        if (found := self.older.get(word)) is None:
            found = xxhash.xxh64_intdigest(word)
        self[word] = found
        return found


_HASHES = WordHashes()
common.CACHES["words"] = _HASHES.empty


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text with A-Z lower-cased; words end at ASCII white space."""
    words = raw.lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order."""
    h = words[: len(words) - k + 1]
    for i in range(1, k):
        h = _mix(h) + words[i : len(words) - k + 1 + i]
    return _mix(h)


def shingles(raw: bytes, k: int) -> np.ndarray:
    """The sorted set of k-word shingles; a shorter text is one shingle, an empty one has none."""
    words = word_hashes(raw)
    if not len(words):
        return words
    short = len(words) < k
    h = gram_hashes(words, len(words) if short else k)
    return np.unique(h ^ np.uint64(len(words) if short else 0))


class Links:
    """Disjoint sets of 0..n-1 that know their sizes and the largest."""

    def __init__(self, n: int):
        self.parent, self.size, self.sets, self.largest = list(range(n)), [1] * n, n, 0

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.parent[b], self.size[a], self.sets = a, self.size[a] + self.size[b], self.sets - 1
            if self.size[a] > self.size[self.find(self.largest)]:
                self.largest = a


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(entry, count) of entries in at least ``need`` of the sorted ``lists``, merged on a heap.

    When the smallest entry is in fewer lists, need - 1 lists are taken off and jump by binary search to the
    smallest entry left: no entry before it can be in enough lists.
    """
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= need:
        top = heap[0][0]
        off = []
        while heap and heap[0][0] == top:
            off.append(heapq.heappop(heap))
        if len(off) >= need:
            yield top, len(off)
            for _, i, at in off:
                if at + 1 < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at + 1], i, at + 1))
            continue
        while len(off) < need - 1 and heap:
            off.append(heapq.heappop(heap))
        if not heap:
            return
        goal = heap[0][0]
        for _, i, at in off:
            if (at := bisect_left(lists[i], goal, at)) < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))


def search(sets: list[np.ndarray], percent: int, known: list | None = None) -> list[int]:
    """For each set the smallest index that links reach, where sets link at a Jaccard similarity of percent/100.

    Sets with equal entries in ``known`` are connected beforehand.

    A query's shingles are inverted lists of the sets that share them. A partner of a set of n shingles shares at
    least T = ceil(n * percent / 100), so of its lists the longest L < T can be left out: partners are in T - L of
    the short lists, which are merged on a heap; the long ones are then probed by binary search until the pair's
    overlap is reached or out of reach. Pairs that links already connect are not probed. A pair of unconnected
    sets has one outside the largest component, so sets inside it need not ask.
    """
    n = [len(s) for s in sets]
    links = Links(len(sets))
    seen: dict = {}
    for i, label in enumerate(known or ()):
        links.join(seen.setdefault(label, i), i)
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(inverse, kind="stable")
    starts = np.concatenate([[0], np.cumsum(counts)])
    sorted_owner = owner[order]
    lists: dict[int, list[int]] = {int(t): sorted_owner[starts[t] : starts[t + 1]].tolist() for t in np.flatnonzero(counts >= 2)}
    bounds = np.concatenate([[0], np.cumsum(n)])

    def ask(q: int) -> None:
        mine = inverse[bounds[q] : bounds[q + 1]]
        mine = mine[counts[mine] >= 2]
        need = -(-n[q] * percent // 100)
        if len(mine) < need:
            return
        mine = mine[np.argsort(counts[mine], kind="stable")]
        longest = len(lists[int(mine[-1])])
        skip = min(need - 1, round(need / (0.0085 * math.log2(longest) + 1)))
        short = [lists[t] for t in mine[: len(mine) - skip].tolist()]
        long = [lists[t] for t in mine[len(mine) - skip :].tolist()]
        for other, found in merge_skip(short, need - skip):
            if links.find(other) == links.find(q):
                continue
            overlap = -(-percent * (n[q] + n[other]) // (100 + percent))
            left = skip
            for x in long:
                if found >= overlap or found + left < overlap:
                    break
                left -= 1
                at = bisect_left(x, other)
                found += at < len(x) and x[at] == other
            if found >= overlap:
                links.join(q, other)

    todo = sorted(range(len(sets)), key=lambda i: n[i])
    asked = True
    while asked and links.sets > 1:  # the largest component may change, so those left out wait for another round
        asked, later = False, []
        for q in todo:
            if links.find(q) != links.find(links.largest):
                ask(q)
                asked = True
            else:
                later.append(q)
        todo = later
    least: dict[int, int] = {}
    return [least.setdefault(links.find(i), i) for i in range(len(sets))]


class Signatures:
    """Signatures of which two sets share so many at least if they link.

    Sets that link differ in at most D = (n1 + n2) * (100 - percent) / (100 + percent) shingles. Cut by ranges of
    the shingles' hashes into P = D + 1 + s parts, they agree in P - D parts or more. A signature stands for the
    content of one part; empty parts have none, so of its signatures a set shares at least P - D less its empty parts
    with each set that links to it. Where that is nothing, as in some small sets, empty parts have one too. D holds for all sizes of a band; pairs across two neighbouring bands have
    signatures of their own. So a set has up to three kinds: its band's, and those with the band above and below.
    """

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]
        ratio = min(BAND, 0.95 * percent / 100)
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, math.ceil(self.starts[-1] / ratio)))
        self.plans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int] | None] = {}

    def plan(self, band: int, across: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Bounds of the parts, a number for each part, and how many two sets agree in; None if none can link."""
        if (band, across) not in self.plans:
            top = self.starts[band + 1] - 1
            most = (top + (top * 100 // self.percent if across else top)) * (100 - self.percent) // (100 + self.percent)
            if most:
                parts = most + 1 + math.ceil(MORE_PARTS * most)
                bounds = np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)
                names = _mix(np.arange(parts, dtype=np.uint64) + np.uint64((2 * band + across) << 32))
                self.plans[band, across] = bounds, names, parts - most
            else:
                self.plans[band, across] = None  # equal sets only, and those are one node
        return self.plans[band, across]

    def kinds(self, h: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
        """For each kind 0 (band), 1 (and above), 2 (and below) of a sorted set: signatures, and how many a link needs."""
        n = len(h)
        band = bisect_right(self.starts, n) - 1
        kinds = [(0, band, 0)]
        if n * 100 // self.percent >= self.starts[band + 1]:
            kinds.append((1, band, 1))
        if band and -(-n * self.percent // 100) < self.starts[band]:
            kinds.append((2, band - 1, 1))
        total, out = np.concatenate([[np.uint64(0)], np.cumsum(_mix(h), dtype=np.uint64)]), []
        for kind, *which in kinds:
            if plan := self.plan(*which):
                bounds, names, agree = plan
                ends = np.concatenate([[0], np.searchsorted(h, bounds), [n]])
                full = np.flatnonzero(np.diff(ends))
                need = agree - (len(names) - len(full))
                if need <= 0:  # a small set, which may agree with another in empty parts only
                    full, need = np.arange(len(names)), 0
                out.append((kind, _mix(total[ends[full + 1]] - total[ends[full]] + names[full]), need))
        return out

    def of(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *(x for _, x, _ in self.kinds(h))])


def _texts(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): the key is a hash of doc_id that a null has as well."""
    return docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """(key, doc_id, n, node, short): the size and 128-bit digest of each row's set, and half of that but two bits as a number.

    Rows without words have no node. The result is a table in the shared folder.
    """
    names = ["key", "doc_id", "n", "node", "short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, shorts = [], [], []
            for raw in batch.column(2):
                s = shingles(raw.as_py() or b"", k)
                node = xxhash.xxh3_128_digest(s) if len(s) else None
                n.append(len(s))
                nodes.append(node)
                shorts.append(_short(node) & -4 if node else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(shorts, pa.int64())], names)

    return common.cut(_texts(docs).mapInArrow(common.task("words", run), "key long, doc_id long, n long, node binary, short long"), "sets")


def _short(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def signature_rows(docs: DataFrame, one: DataFrame, k: int, percent: int) -> DataFrame:
    """(signature, node, need): the signatures of the sets of ``one`` (key), each with a set of a kind that has it.

    ``node`` is ``short`` with its last two bits replaced by the kind. A task sends a signature once, with the set
    that shares most there, its lead, so one of a very common set leaves a task once, however many sets there have it.
    The sets that share it with the lead have a row each for a signature that stands for the lead, with a ``need`` of
    MEMBER or, the lead itself, LEAD; the signature's own row then has SHARED. One row for each set of a kind tells how many signatures it must share with
    other tasks' sets to link to any; other rows have no need.
    """
    marked = docs.sparkSession.sparkContext.broadcast(bitmap(one))  # 2 ** MAP_BITS bits

    def merged(told: list[np.ndarray], ids: list[int], needs: list[int]) -> pa.RecordBatch:
        signature = np.concatenate([np.empty(0, np.uint64), *told])
        at = np.repeat(np.arange(len(told)), [len(x) for x in told])
        order = np.argsort(signature, kind="stable")
        signature, at = signature[order], at[order]
        first = np.concatenate([[True], signature[1:] != signature[:-1]])[: len(signature)]
        group = np.cumsum(first) - 1
        common_to = np.bincount(group) if len(group) else np.empty(0, np.int64)
        here = np.bincount(at[common_to[group] > 1], minlength=len(told))
        order = np.lexsort((at, here[at], group))  # the last of each group is its lead
        last = np.append(first[1:], True)[: len(signature)]
        lead = at[order][last]
        pairs = np.unique(np.stack([lead[group], at[order]], axis=1)[lead[group] != at[order]], axis=0)
        leads, ids = np.unique(pairs[:, 0]), np.array(ids, np.int64)
        star = lambda x: _mix(ids[x].view(np.uint64) ^ np.uint64(1 << 63))
        by_lead = np.argsort(lead, kind="stable")  # equal nodes in a row compress
        parts = [
            (signature[first][by_lead], ids[lead][by_lead], SHARED),
            (star(pairs[:, 0]), ids[pairs[:, 1]], MEMBER),
            (star(leads), ids[leads], LEAD),
            (_mix(ids.view(np.uint64)), ids, np.maximum(np.array(needs, np.int64) - here, 0)),
        ]
        alone = np.concatenate([common_to[by_lead] == 1, np.zeros(sum(len(x) for x, _, _ in parts[1:]), bool)])
        need = pa.array(np.concatenate([np.broadcast_to(n, len(x)) for x, _, n in parts]).astype(np.int64), mask=alone)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _, _ in parts]).view(np.int64)), pa.array(np.concatenate([x for _, x, _ in parts])), need], ["signature", "node", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, told, ids, needs, held = Signatures(percent), [], [], [], 0
        for _, nodes, sets in _chosen(batches, marked.value, k):
            for node, s in zip(nodes, sets, strict=True):
                for kind, found, need in signatures.kinds(s):
                    told.append(found)
                    ids.append(_short(node) & -4 | kind)
                    needs.append(need)
                    held += len(found)
                if held > MERGED:
                    yield merged(told, ids, needs)
                    told, ids, needs, held = [], [], [], 0
        yield merged(told, ids, needs)

    return _texts(docs).select("key", "text").mapInArrow(common.task("words", run), "signature long, node long, need long")


def candidates(docs: DataFrame, one: DataFrame, k: int, percent: int) -> DataFrame:
    """(short, root): groups of the sets of ``one`` (key) that may link; ``short`` without its last two bits.

    A set that shares fewer signatures with all others together than a single link needs has no link, so it is in no
    group: documents that have a common passage seldom share so many. Shared signatures connect the others; sets that
    link are in one group.
    """
    told = signature_rows(docs, one, k, percent).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("signature")))
    told = common.cut(told.where("n > 1 OR need >= 0").drop("n"), "shared")
    common.release(docs.sparkSession)  # the largest shuffle of all
    shared = F.count_if(F.col("need").isNull())
    may = told.groupBy("node").agg(shared.alias("shared"), F.max(F.when(F.col("need") >= 0, F.col("need"))).alias("need"), (F.min("need") == LEAD).alias("lead"))
    may = common.cut(may.withColumn("may", F.col("shared") >= F.col("need")).where("may OR lead").select("node", "may"), "may")
    rows = told.where("need IS NULL OR need < 0").join(may.select("node"), "node").select("signature", (F.col("node").bitwiseAND(F.lit(-4))).alias("u"))
    rows = rows.withColumn("v", F.min("u").over(W.partitionBy("signature")))
    found = common.components(rows.where("u <> v").select("u", "v"))
    sets = may.where("may").select((F.col("node").bitwiseAND(F.lit(-4))).alias("node")).distinct()
    groups = common.cut(found.join(sets, "node").select(F.col("node").alias("short"), "root"), "groups")
    common.release(docs.sparkSession)
    return groups


def _place(key: np.ndarray) -> np.ndarray:
    return key.view(np.uint64) >> np.uint64(64 - MAP_BITS)


def bitmap(keys: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MAP_BITS, bool)
        for batch in batches:
            bits[_place(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], ["bits"])

    return common.tree_merge(keys.select("key").mapInArrow(common.task("words", run), "bits binary"), "u1", (1 << MAP_BITS) // 8, np.bitwise_or)


def _chosen(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, k: int) -> Iterator[tuple[list[int], list[bytes], list[np.ndarray]]]:
    """Keys, nodes and sets of the texts of (key, text) whose key is in the bitmap, some at a time."""
    keys, nodes, sets, held = [], [], [], 0
    for batch in batches:
        place = _place(batch.column(0).to_numpy()).astype(np.int64)
        batch = batch.filter(pa.array(((bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool)))
        for key, raw in zip(*batch.columns, strict=True):
            s = shingles(raw.as_py() or b"", k)
            if len(s):
                keys.append(key.as_py())
                nodes.append(xxhash.xxh3_128_digest(s))
                sets.append(s)
                held += s.nbytes
            if held > HELD:
                yield keys, nodes, sets
                keys, nodes, sets, held = [], [], [], 0
    yield keys, nodes, sets


def _members(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(key, node, shingles): the sets of the documents of ``chosen`` (key), made once more, and of few others."""
    marked = docs.sparkSession.sparkContext.broadcast(bitmap(chosen))  # 2 ** MAP_BITS bits

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, sets in _chosen(batches, marked.value, k):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "node", "shingles"])

    return _texts(docs).select("key", "text").mapInArrow(common.task("words", again), "key long, node binary, shingles binary")


def _found(docs: DataFrame, dealt: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """(u, v): the links, as each set with the first that it reaches, within each (root, part) of ``dealt``.

    ``dealt`` (node, key, task, root, part, n, known) names the sets that a task searches, one document for each, with
    what connects some of them beforehand. Shingles are made once more, of those documents only. A set may go to many
    tasks, so these run in batches that are sent about ``most`` shingles each, and a batch's shuffle is released
    before the next one's is written: what is on disk at once does not grow with the number of pairs of chunks.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby(["root", "part"]):
            part = part.drop_duplicates("node").sort_values("node")
            nodes = part["node"].tolist()
            found = search([np.frombuffer(x, "<u8") for x in part["shingles"]], percent, part["known"].tolist())
            sizes = np.bincount(found)
            out += [(nodes[i], nodes[f]) for i, f in enumerate(found) if sizes[f] > 1]
        return pd.DataFrame(out, columns=["u", "v"])

    batches = max(1, math.ceil((dealt.agg(F.sum("n")).first()[0] or 0) / most))
    members = _members(docs, dealt, k)
    if batches > 1:
        members = common.cut(members, "members")
    found = None
    for i in range(batches):
        batch = dealt.where(F.pmod(F.xxhash64("task", F.lit(3)), F.lit(batches)) == i) if batches > 1 else dealt
        sent = members.join(batch, ["node", "key"]).select("task", "root", "part", "node", "known", "shingles")
        now = common.cut(sent.groupBy("task").applyInPandas(run, "u binary, v binary"), "found")
        found = found.unionAll(now) if found else now
        common.release(docs.sparkSession)
    if batches > 1:
        common.drop(members)
    return found


def narrowed(docs: DataFrame, part: DataFrame, k: int, percent: int) -> DataFrame:
    """(short, root): the sets of ``part`` (node, short, key, root, n) that may link to others of their root, in smaller groups.

    A set that links shares at least T = ceil(n * percent / 100) shingles with its partner. In one order of all the
    root's shingles, rarest first, the first one that both have comes before T - 1 others that both have; so two sets
    that link have a shingle in common that is not among the last T - 1 of either. Only those before connect sets; one
    whose shingles before are all its own is in no group. What sets have from common passages comes last in that order,
    so unlike signatures it connects only sets that hold little else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SENT_ROWS):
                raw, root, short, n = (x.to_numpy(zero_copy_only=False) for x in batch.slice(at, SENT_ROWS).columns)
                own = np.frombuffer(b"".join(raw), "<u8") ^ np.repeat(_mix(root.view(np.uint64)), n)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.repeat(short, n)), pa.array(np.repeat(n, n))], ["shingle", "u", "n"])

    sets = _members(docs, part, k).join(part, ["node", "key"]).select("shingles", "root", "short", "n")
    rows = common.cut(sets.mapInArrow(common.task("words", run), "shingle long, u long, n long"), "grams")
    common.release(docs.sparkSession)
    often = common.cut(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "often")
    shared = common.hot_join(rows, often, ["shingle"], "sets", "u", table=True)
    rank = F.row_number().over(W.partitionBy("u").orderBy("sets", "shingle"))
    shared = shared.withColumns({"rank": rank, "shared": F.count(F.lit(1)).over(W.partitionBy("u"))})
    before = F.col("shared") + 1 - F.ceil(F.col("n") * percent / 100)
    early = common.cut(shared.where(F.col("rank") <= before).select("shingle", "u"), "early")
    common.drop(rows)
    common.drop(often)
    common.release(docs.sparkSession)
    least = common.cut(early.groupBy("shingle").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("sets")).where("sets > 1"), "least")
    found = common.components(common.hot_join(early, least, ["shingle"], "sets", "u", table=True).where("u <> v").select("u", "v"))
    groups = common.cut(found.select(F.col("node").alias("short"), "root"), "groups")
    common.release(docs.sparkSession)
    return groups


def _grouped(docs: DataFrame, nodes: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """(node, short, key, root, n): ``nodes`` (node, short, key, n) that may link, by candidate group.

    Groups too large for one task, mostly sets that common passages have chained by chance, are cut by their rare
    shingles, which are counted anew within the groups of each round. That ends once it cuts little, as true clusters stay.
    """
    groups = candidates(docs, nodes, k, percent)
    one = common.cut(nodes.join(groups, "short").select("node", "short", "key", "root", "n"), "candidates")
    before = None
    for _ in range(ROUNDS):
        sizes = one.groupBy("root").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("sets")).where(F.col("size") > block)
        large = common.cut(sizes, "large")
        now = large.agg(F.sum("size")).first()[0]
        if not now or (before and now > WORTH * before):
            break
        before = now
        part = common.cut(common.hot_join(one, large, ["root"], "sets", "node").select(*one.columns), "part")
        again = narrowed(docs, part, k, percent).withColumnRenamed("root", "other")
        part = part.join(again, "short").withColumn("root", F.xxhash64("root", "other")).select(*one.columns)
        rest = one.join(large.select("root"), "root", "left_anti").select(*one.columns)
        one = common.cut(rest.unionByName(part), "candidates")
        common.release(docs.sparkSession)
    return one


def links(docs: DataFrame, nodes: DataFrame, k: int, percent: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(node, root) for every set that links to another: the smallest node of its component.

    The shingles of candidates alone are made once more, from one document for each set. A group too large for a task
    is cut into chunks, each searched with the group's leaders, which connects most of a true cluster. What is then
    outside the group's largest component is searched against all chunks, and only that: links within a component
    tell nothing new.
    """
    one = _grouped(docs, nodes, k, percent, block)
    chunks = one.groupBy("root").agg(F.ceil(F.sum("n") / block).alias("chunks"), F.count(F.lit(1)).alias("sets"))
    one = common.cut(common.hot_join(one, common.cut(chunks, "chunks"), ["root"], "sets", "node"), "chunked")
    some = one.agg(F.sum("n"), F.max("chunks")).first()
    most = max(SENT_LEAST, int(SENT_SHARE * (nodes.agg(F.sum("n")).first()[0] or 0)))
    tasks = max(1, math.ceil((some[0] or 0) * TASK_SHARE / block))
    task = F.when(F.col("chunks") > 1, F.xxhash64("root", "part")).otherwise(F.pmod(F.xxhash64("root"), F.lit(tasks)))
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    columns = ["node", "key", "task", "root", "part", "n", "known"]
    unknown = lambda df: df.withColumns({"task": task, "known": F.col("node")}).select(*columns)
    large = one.where("chunks > 1")
    led = large.groupBy("root", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(LEADERS))).agg(F.min(F.struct("node", "key", "n")).alias("lead"), F.first("chunks").alias("chunks"))
    led = led.select("lead.node", "lead.key", "lead.n", "root", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part"))
    found = _found(docs, common.cut(unknown(one.withColumn("part", own)).unionByName(unknown(led)), "dealt"), k, percent, most)
    if (some[1] or 1) == 1:
        return found.select(F.col("u").alias("node"), F.col("v").alias("root"))
    labels = common.components(found)
    large = large.join(labels.select("node", F.col("root").alias("label")), "node", "left").withColumn("known", F.coalesce("label", "node"))
    large = common.cut(large.drop("label"), "labelled")
    sizes = large.groupBy("root", "known").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("root").agg(F.max_by("known", F.struct("size", "known")).alias("main"), F.sum("size").alias("sets"))
    large = common.cut(common.hot_join(large.drop("sets"), common.cut(main, "main"), ["root"], "sets", "node"), "led")
    others = large.where("known <> main")
    asking = others.groupBy("root").agg(F.ceil(F.sum("n") / block).alias("asks"), F.first("sets").alias("sets"))
    asking = common.cut(asking, "asking")
    if asking.isEmpty():
        return labels
    large = common.hot_join(large.drop("sets"), asking, ["root"], "sets", "node")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    ask = F.pmod(F.xxhash64("node", F.lit(2)), F.col("asks"))
    asked = large.withColumn("ask", each("asks")).withColumn("part", F.col("ask") * F.col("chunks") + own)
    asks = large.where("known <> main").withColumn("chunk", each("chunks")).withColumn("part", ask * F.col("chunks") + F.col("chunk"))
    dealt = asked.select("node", "key", "root", "part", "n", "known").unionByName(asks.select("node", "key", "root", "part", "n", "known"))
    more = _found(docs, common.cut(dealt.withColumn("task", F.xxhash64("root", "part")).select(*columns), "dealt"), k, percent, most)
    return common.components(found.unionByName(more))


@common.tidy
def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_shingles and component_id.

    Documents link when the Jaccard similarity of their sets of k-word shingles reaches percent/100; component_id is
    the smallest doc_id that links reach. Equal sets are one node, so copies are never paired. Sets that share a
    signature form candidate groups, which no link leaves; each group is searched exactly, one too large for a task in
    chunks. Signatures, candidates and links cover the whole
    corpus; only a bitmap of fixed size is sent to all tasks.

    Defined results: words end at ASCII white space and A-Z are lower-cased; a text of fewer than k words is one
    shingle; a null or empty text has none and is linked with nothing; repeated rows link as copies do; a null
    doc_id is never a component's smallest; an empty table gives no rows; other columns are ignored.
    """
    rows = set_table(docs, k)
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("short").alias("short"))
    linked = links(docs, common.cut(nodes, "nodes"), k, percent, block).withColumnRenamed("root", "top")
    rows = rows.select("doc_id", "n", "node")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(linked, "node", "left")
    nodes = nodes.select("node", "least", F.coalesce("top", "node").alias("top"))
    tops = nodes.groupBy("top").agg(F.min("least").alias("component_id"))
    found = rows.join(nodes.join(tops, "top").select("node", "component_id"), "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


@common.tidy
def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that have a smaller doc_id in their component; a null doc_id stays.

    Rows that share a doc_id stay or go together. Defined results are otherwise those of ``near_duplicates``; all
    columns stay, whatever their names.
    """
    found = near_duplicates(docs, k, percent)
    gone = common.cut(found.where("component_id <> doc_id").select(F.xxhash64("doc_id").alias("key"), F.col("doc_id").alias("gone")).distinct(), "gone")
    marked = docs.sparkSession.sparkContext.broadcast(bitmap(gone))  # 2 ** MAP_BITS bits
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col("doc_id").cast("long")).alias("key"))

    def part(inside: bool) -> DataFrame:
        """Documents in the bitmap, which may have to go, or the others, which stay and are not shuffled."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(marked.value).view(bool)
            for batch in batches:
                yield batch.filter(pa.array(bits[_place(batch.column(1).to_numpy())] == inside))

        return keyed.mapInArrow(common.task("words", run), keyed.schema)

    # the row is one column until the join is done, so that no name of its own can clash
    stay = part(True).join(gone.select("gone"), F.col("doc.doc_id").cast("long") == F.col("gone"), "left_anti")
    return part(False).unionAll(stay).select("doc.*")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=3, percent=90)


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
sets AS (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n FROM grams),
flat AS (SELECT doc_id, n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.other = l.u)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""
