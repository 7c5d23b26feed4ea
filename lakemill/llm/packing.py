"""Packing of tokenised documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import common

WINDOW = 2048
END_ID = 1
#: Pieces that one packing task holds, about; each document has one at most that does not fill a window.
BUCKET_ROWS = 50_000
#: Words kept in a worker's token cache; it holds two generations of half as many.
CACHE_WORDS = 700_000

_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ASCII_END = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_COMBINING = re.compile("[\u0300-\u036f]")
#: Python's white space that the tokenizer's is not, and words between the tokenizer's.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WORD = re.compile("(?:[\x1c-\x1f]|\\S)+")


class WordTokens(dict):
    """Token ids of white-space separated words, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn.
    Each word is encoded once and remembered; when the newer generation is full, it becomes the older one.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.older = Tokenizer.from_file(path), limit // 2, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            stem = word.rstrip(_PUNCTUATION)
            if stem and stem != word and stem[-1] in _ASCII_END and "<|" not in word:
                ids = self[stem] + self[word[len(stem) :]]
            else:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" not in text and not _COMBINING.search(text):  # then lower-casing A-Z changes no id
            text = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return b"".join(map(self.__getitem__, _WORD.findall(text) if _SEPARATORS.search(text) else text.split()))


_WORDS: dict[str, WordTokens] = {}
common.CACHES["tokens"] = _WORDS.clear


def word_tokens(path: str) -> WordTokens:
    """One cache for each Python worker and vocabulary."""
    if path not in _WORDS:
        _WORDS[path] = WordTokens(path)
    return _WORDS[path]


class FitTree:
    """Open windows by remaining capacity; a segment tree finds the tightest that still fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The smallest room of at least ``need``, with a window that has it."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length; ``lengths`` must be descending and at most ``capacity``."""
    window, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int(np.searchsorted(-lengths, -capacity, side="right"))
    window[:full] = np.arange(full)
    tree, used = FitTree(capacity), full
    for i, n in enumerate(lengths[full:].tolist(), full):
        if found := tree.take(n):
            room, w = found
        else:
            room, w, used = capacity, used, used + 1
        window[i], offset[i] = w, capacity - room
        if room > n:
            tree.add(room - n, w)
    return window, offset


def tokenise(docs: DataFrame, vocabulary: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids: every full window of a document, then what is left."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, row = word_tokens(vocabulary), np.array([END_ID], "<u4").tobytes(), 0
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.encode(text.as_py() or "") + end
                row += 1
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    out.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, row))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(common.task("tokens", cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")


@common.tidy
def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text) into windows of at most ``window`` ids.

    A document's ids are those of its text, then one end id. Overlong documents are first cut into full windows,
    which need no place and are sequences as they are, so a document of any length adds one piece to a task at most.
    What is left is packed by best-fit decreasing. Only (document, start, length, checksum) is written and shuffled,
    never a token. Pieces are dealt by a hash into buckets of about ``bucket_rows``, so a document or source with a
    third of all rows spreads over all of them, and each bucket is packed in one task.

    Defined results: a null or empty text is the end id alone; repeated rows are packed once each; an empty table
    gives no rows; a null doc_id stays null; other columns are ignored.
    """
    pieces = common.cut(tokenise(docs, vocabulary, window), "pieces")
    full = pieces.where(F.col("length") == window).drop("row")
    # numbers from 2 ** 62 on are of full windows, those below of buckets
    number = F.lit(1 << 62).cast("long") + F.monotonically_increasing_id()
    full = full.withColumns({"sequence_id": number, "offset": F.lit(0).cast("long"), "sequence_padded": F.lit(window).cast("long")})
    rest = pieces.where(F.col("length") < window)
    buckets = max(1, math.ceil(rest.count() / bucket_rows))
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(buckets)).cast("long")).drop("row")

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        w, offset = best_fit_decreasing(frame["length"].to_numpy(), window)
        used = np.bincount(w, weights=frame["length"].to_numpy()).astype(np.int64)
        padded = np.where((used & (used - 1)) == 0, used, window)
        return frame.assign(sequence_id=w + (int(key[0]) << 40), offset=offset, sequence_padded=padded[w]).drop(columns="bucket")

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_padded long"
    return full.unionByName(rest.groupBy("bucket").applyInPandas(place, schema))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
