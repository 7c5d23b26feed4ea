"""What the corpus operators share: the shared scratch folder, table reads and bounded tree merges."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from functools import reduce, wraps
from operator import or_
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashes in a table of bits, 2 to this power: at most 2 ** (BITS - 6) rows of two numbers, whatever the input.
BITS = 24

#: Rows of one key from which a join deals them over SALTS tasks.
HOT = 5000
SALTS = 64

#: Rows and bytes that Python workers get at once at most: they hold texts of any length.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: What empties each cache that Python workers keep from task to task, by name.
CACHES: dict[str, Callable[[], None]] = {}
#: Edges that a task contracts at once at most.
CONTRACTED = 400_000
#: Paths of the tables made in each of the running operators.
_SCOPES: list[set[str]] = []


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only a local master, as in tests, gets a local one where that is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(spark, "_lakemill_scratch", None):
        spark._lakemill_scratch = tempfile.mkdtemp(prefix="lakemill-")
    return spark._lakemill_scratch


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, and bounds what they get at once.

    Functions in tasks are found by module name, so a worker must be able to import the package wherever it starts.
    """
    context = spark.sparkContext
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    if getattr(context, "_lakemill_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    files = sorted((root / "lakemill").rglob("*.py"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for p in files:
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root))), p.read_bytes())
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/lakemill-{hashlib.sha256(out.getvalue()).hexdigest()[:16]}.zip")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(out.getvalue()))
    stream.close()
    context.addPyFile(path.toString())
    context._lakemill_shipped = True


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which a running operator deletes at its end if its result does not read it."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.add(path)
    return path


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it again.

    The lineage ends there: a lost executor costs the tasks that read the table, not those that made it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Deletes a table that ``cut`` made, once nothing reads it any more."""
    spark = df.sparkSession
    read = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    delete(spark, (x for x in read if f"/{spark.sparkContext.applicationId}/" in x or "/lakemill-" in x))


@contextmanager
def tables_made() -> Iterator[set[str]]:
    """The paths of the tables that are made within."""
    made: set[str] = set()
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.pop()


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that deletes the tables it has made, but for those that its result still reads."""

    @wraps(operator)
    def run(*args: object, **how: object) -> DataFrame:
        with tables_made() as made:
            found = operator(*args, **how)
        read = {f.rsplit("/", 2)[-2] for f in found.inputFiles()}
        delete(found.sparkSession, (path for path in made if path.rsplit("/", 1)[1] not in read))
        release(found.sparkSession)
        return found

    return run


def task(name: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` as a worker does it: first the caches of other operators are emptied, at the end free memory is given back.

    A worker stays for later tasks, and what it keeps is memory that the executor's other work does not get.
    """

    def whole(batches: Iterator) -> Iterator:
        for other, empty in CACHES.items():
            if other != name:
                empty()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that nothing refers to any more.

    They go when the driver collects its garbage, which may be long after the table they led to was written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree_merge(blobs: DataFrame, dtype: str, size: int, merge: np.ufunc = np.add) -> np.ndarray:
    """Merges one-column rows that hold arrays of ``size`` numbers as bytes, in a tree; the result has a fixed size."""

    def both(a: bytes, b: bytes) -> bytes:
        return merge(np.frombuffer(a, dtype), np.frombuffer(b, dtype)).tobytes()

    rows = blobs.rdd.map(lambda r: bytes(r[0]))
    zero = np.zeros(size, dtype).tobytes()
    return np.frombuffer(rows.treeAggregate(zero, both, both, depth=3) if rows.getNumPartitions() else zero, dtype)


def _slot(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - BITS + 6)


def bit_table(keys: DataFrame) -> DataFrame:
    """(slot, mask) for the 64-bit hashes in the only column of ``keys``: a set of fixed size that may be sent to all tasks."""
    key = F.col(f"`{keys.columns[0]}`")
    bit = F.expr("shiftleft(1L, CAST(place AS INT))")
    places = keys.select(_slot(key).alias("slot"), (F.shiftrightunsigned(key, 64 - BITS) % 64).alias("place"))
    return cut(places.groupBy("slot").agg(F.bit_or(bit).alias("mask")), "bits")


def maybe_in(rows: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """Adds the boolean ``name``: true for every key of the set ``bits``, and for few others while the set is sparse."""
    place = F.shiftrightunsigned(key, 64 - BITS) % 64
    told = rows.join(F.broadcast(bits.select(F.col("slot").alias("__slot"), F.col("mask").alias("__mask"))), _slot(key) == F.col("__slot"), "left")
    hit = F.coalesce(F.col("__mask").bitwiseAND(F.expr("shiftleft(1L, CAST(__place AS INT))")) != 0, F.lit(False))
    return told.withColumn("__place", place).withColumn(name, hit).drop("__slot", "__mask", "__place")


def hot_join(rows: DataFrame, told: DataFrame, key: list[str], n: str, *by: str, how: str = "inner", hint: str | None = None, table: bool = False) -> DataFrame:
    """``rows`` joined with ``told``, which has each key once and in ``n`` how many rows have it.

    Where ``told`` is a ``table`` it may be read twice, so that none but hot keys are made more rows of.

    Rows of a key that more than HOT have are dealt over SALTS tasks by a hash of the columns ``by``, and ``told``
    goes to each of them; rows without a key, which meet nothing, are dealt likewise. Which keys are hot is sent as a
    set of fixed size.
    """
    hashed = F.xxhash64(*key)
    hot = bit_table(told.where(F.col(n) > HOT).select(hashed))
    last = F.when(F.col("__hot"), F.lit(SALTS - 1)).otherwise(F.lit(0))
    told = maybe_in(told, hashed, hot, "__hot")
    if table:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        told = told.where("NOT __hot").withColumn("__salt", F.lit(0)).unionByName(told.where("__hot").withColumn("__salt", salts)).drop("__hot")
    else:
        told = told.withColumn("__salt", F.explode(F.sequence(F.lit(0), last))).drop("__hot")
    spread = F.col("__hot") | reduce(or_, (F.col(k).isNull() for k in key))
    salt = F.when(spread, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    rows = maybe_in(rows, hashed, hot, "__hot").withColumn("__salt", salt).drop("__hot")
    return rows.join(told.hint(hint) if hint else told, [*key, "__salt"], how).drop("__salt")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not the smallest of its component, and that smallest one; numbers or bytes."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(inverse, 2)
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    kept = parent != np.arange(len(nodes))
    return nodes[kept], nodes[parent[kept]]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (u, v) with the same components: those that a task has, as stars, up to CONTRACTED at once."""
    kind = dict(edges.dtypes)["u"]
    arrow = pa.int64() if kind == "bigint" else pa.binary()

    def array(batches: list[pa.RecordBatch], column: int) -> np.ndarray:
        found = pa.chunked_array([b.column(column) for b in batches], arrow)
        return found.to_numpy() if arrow == pa.int64() else np.array(found.to_pylist(), object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > CONTRACTED:
                yield stars(held)
                held, rows = [], 0
        if rows:
            yield stars(held)

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, arrow) for x in forest(array(held, 0), array(held, 1))], ["u", "v"])

    return edges.select("u", "v").coalesce(tasks).mapInArrow(task("none", run), f"u {kind}, v {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node that links reach.

    Edges are contracted within each task first, which leaves some for each node and task at most. If those are few, a
    task contracts them all; else large and small stars alternate until no edge changes. Minima are aggregated before the shuffle and joined
    back, so that a hub's edges can be split among tasks; each round ends in a table in the shared folder.
    """
    edges = _contracted(edges.where("u <> v"), max(edges.sparkSession.sparkContext.defaultParallelism, 2))
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if edges.count() <= CONTRACTED:  # few enough for one task, whatever they came from
        found = cut(_contracted(edges, 1), "edges")
        return found.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(found.select("v", "v").distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        after = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        drop(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v").distinct())
