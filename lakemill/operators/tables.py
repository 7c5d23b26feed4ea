"""Versioned tables on Parquet: commits, history, time travel, update, merge and transactions.

A version is a log entry that names its schema and its data folders. Data are written first; the entry is renamed
into place, which fails if the version exists, so a version is seen whole or not at all. Old folders are never
changed, so an older version stays readable and a lost executor costs only its tasks.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.operators.constraints import violations
from lakemill.sources.fs import Exists, Files


COMMITTED, ABORTED, PENDING = "committed", "aborted", "pending"


CommitConflict = Exists  # another writer published the version first


class ConstraintViolation(ValueError):
    """Rows that a table's constraints do not accept; ``broken`` has each constraint's number of rows."""

    def __init__(self, broken: Mapping[str, int]):
        super().__init__(", ".join(f"{name}: {n} rows" for name, n in sorted(broken.items())))
        self.broken = dict(broken)


class VersionedTable:
    """``clock`` gives a commit's time in seconds, and tests a fixed one.

    A handle remembers the version that it read last. What replaces a table's rows may only follow that version: if
    another writer has published meanwhile, ``CommitConflict`` is raised and nothing is lost. Appended rows depend on
    no version, so an append is put after whatever was published before it.
    """

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.clock, self.files = spark, path.rstrip("/"), clock, Files(spark, path)
        self.seen: int | None = None

    def _log(self, version: int) -> str:
        return f"{self.path}/_log/{version:08d}.json"

    def _versions(self) -> list[int]:
        return [int(n[:8]) for n in self.files.names(f"{self.path}/_log") if n.endswith(".json") and n[0] != "."]

    def _entry(self, version: int) -> dict:
        return json.loads(self.files.read(self._log(version)))

    def _state(self, entry: dict) -> str:
        """Whether a version is committed, or its transaction was aborted or is still pending."""
        if not entry.get("manifest"):
            return COMMITTED
        return json.loads(self.files.read(entry["manifest"]))["state"] if self.files.exists(entry["manifest"]) else PENDING

    def entries(self) -> list[dict]:
        """Committed versions, oldest first."""
        return [e for e in map(self._entry, self._versions()) if self._state(e) == COMMITTED]

    def latest(self) -> dict:
        """The last committed version; an entry tells a version whole, so only the newest are read."""
        for version in reversed(self._versions()):
            if self._state(entry := self._entry(version)) == COMMITTED:
                return entry
        raise ValueError(f"{self.path} has no version")

    def read(self, version: int | None = None) -> DataFrame:
        if version is None:
            entry = self.latest()
            self.seen = entry["version"]
        elif version not in self._versions() or self._state(entry := self._entry(version)) != COMMITTED:
            raise ValueError(f"{self.path} has no version {version}")
        schema = T.StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*entry["folders"]) if entry["folders"] else self.spark.createDataFrame([], schema)

    def read_as_of(self, seconds: float) -> DataFrame:
        """The last version published at or before a time."""
        if not (found := [e for e in self.entries() if e["timestamp"] <= seconds]):
            raise ValueError(f"{self.path} has no version as of {seconds}")
        return self.read(found[-1]["version"])

    def history(self) -> DataFrame:
        rows = [(e["version"], float(e["timestamp"]), e["operation"], e["rows"]) for e in self.entries()]
        return self.spark.createDataFrame(rows, "version long, seconds double, operation string, rows long").select("version", F.timestamp_micros((F.col("seconds") * 1_000_000).cast("long")).alias("timestamp"), "operation", "rows")

    def _base(self) -> tuple[int, dict | None]:
        """The number of the next version, and the version that it follows.

        A pending transaction in between is aborted, as its rows would else be left out of what follows; it then
        fails as a whole. If it is committed at the same moment, its version is the one to follow.
        """
        for version in reversed(numbers := self._versions()):
            entry = self._entry(version)
            if self._state(entry) == PENDING:
                with contextlib.suppress(CommitConflict):
                    self.files.publish(entry["manifest"], json.dumps({"state": ABORTED}))
            if self._state(entry) == COMMITTED:
                return numbers[-1] + 1, entry
        return (numbers[-1] + 1 if numbers else 0), None

    def stage(self, df: DataFrame, mode: str = "overwrite", operation: str | None = None, evolve: bool = False, manifest: str | None = None, **more: object) -> tuple[str, str]:
        """Writes the data of the next version; gives its log entry's path and text. ``more`` is kept in the entry."""
        version, found = self._base()
        if mode != "append" and self.seen is not None and found and found["version"] != self.seen:
            raise CommitConflict(f"{self.path}: version {self.seen} was read, {found['version']} is there")
        folders, before, schema = [], 0, df.schema
        if mode == "append" and found:
            old = T.StructType.fromJson(found["schema"])
            extra = [f for f in df.schema if f.name not in old.names]
            missing = [f for f in old if f.name not in df.columns]
            if (extra or missing) and not evolve:
                raise ValueError(f"columns differ: {[f.name for f in extra + missing]}")
            schema = T.StructType([*old, *extra])
            df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
            folders, before = found["folders"], found["rows"]
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        rows = self.spark.read.schema(schema).parquet(folder).count()
        kept = {"constraints": found["constraints"]} if found and found.get("constraints") else {}
        entry = {"version": version, "timestamp": self.clock(), "operation": operation or mode.upper(), "schema": json.loads(schema.json()), "rows": before + rows, "added": rows, "folders": [*folders, folder], "manifest": manifest, **kept, **more}
        return self._log(version), json.dumps(entry)

    def commit(self, df: DataFrame, mode: str = "overwrite", operation: str | None = None, evolve: bool = False, **more: object) -> int:
        path, text = self.stage(df, mode, operation, evolve, **more)
        while True:
            entry = json.loads(text)
            try:
                self.files.publish(path, text)
            except CommitConflict:
                if mode != "append":
                    raise
                version, found = self._base()  # the rows that were written stay; they follow the version that came first
                if not found or found["schema"] != entry["schema"]:
                    raise
                entry |= {"version": version, "rows": found["rows"] + entry["added"], "folders": [*found["folders"], entry["folders"][-1]]}
                path, text = self._log(version), json.dumps(entry)
            else:
                self.seen = entry["version"]
                return entry["version"]

    def create(self, schema: str, not_null: Sequence[str] = (), defaults: Mapping[str, str] = {}, checks: Mapping[str, str] = {}, unique: Mapping[str, Sequence[str]] = {}, foreign: Mapping[str, tuple[str, str, str]] = {}) -> int:  # noqa: B006
        """An empty table with constraints that ``insert`` holds rows against.

        Defaults and checks are SQL expressions; a foreign key is (column, path of the parent table, its column).
        """
        constraints = {"not_null": list(not_null), "defaults": dict(defaults), "checks": dict(checks), "unique": {k: list(v) for k, v in unique.items()}, "foreign": {k: list(v) for k, v in foreign.items()}}
        return self.commit(self.spark.createDataFrame([], schema), operation="CREATE TABLE", constraints=constraints)

    def insert(self, df: DataFrame) -> int:
        """Appends rows; columns that they lack get their default or null. If a row breaks a constraint, none is added."""
        entry = self.latest()
        told, old = entry.get("constraints") or {}, self.read(entry["version"])
        default = lambda f: F.expr(told["defaults"][f.name]) if f.name in told.get("defaults", {}) else F.lit(None)
        rows = df.select(*((F.col(f.name) if f.name in df.columns else default(f)).cast(f.dataType).alias(f.name) for f in old.schema))
        checks = {f"not_null_{c}": F.col(c).isNotNull() for c in told.get("not_null", [])} | {k: F.expr(v) for k, v in told.get("checks", {}).items()}
        foreign = {k: (c, VersionedTable(self.spark, path).read(), key) for k, (c, path, key) in told.get("foreign", {}).items()}
        both = old.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1))) if told.get("unique") else rows.withColumn("__new", F.lit(1))
        broken = violations(both, checks, told.get("unique", {}), ["__new"], foreign).where("__new = 1 AND violated IS NOT NULL")
        if counts := {r["violated"]: r["n"] for r in broken.groupBy("violated").agg(F.count(F.lit(1)).alias("n")).collect()}:  # one row a constraint
            raise ConstraintViolation(counts)
        self.seen = entry["version"]
        path, text = self.stage(rows, "append", "INSERT")
        if told.get("unique") and json.loads(text)["version"] != entry["version"] + 1:
            raise CommitConflict(f"{self.path}: rows were added after keys were compared")
        self.files.publish(path, text)
        self.seen = json.loads(text)["version"]
        return self.seen

    def updated(self, condition: Column, values: Mapping[str, Column]) -> DataFrame:
        df = self.read()
        hit = F.coalesce(condition, F.lit(False))
        return df.select(*(F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in df.schema))

    def update(self, condition: Column, values: Mapping[str, Column]) -> int:
        return self.commit(self.updated(condition, values), operation="UPDATE")

    def merged(self, source: DataFrame, on: Sequence[str], when_matched: Column | None = None, values: Mapping[str, Column] | None = None, insert: bool = True) -> DataFrame:
        """The next version after a merge; ``t`` and ``s`` name both sides in the expressions.

        Without ``values`` a matched row takes all columns that the source has. A source key that occurs twice raises.
        """
        twice = source.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not twice.isEmpty():
            raise ValueError("a source key matches twice")
        target = self.read()
        t, s = target.withColumn("__t", F.lit(True)).alias("t"), source.withColumn("__s", F.lit(True)).alias("s")
        keys = F.lit(True)
        for k in on:
            keys = keys & (F.col(f"t.{k}") == F.col(f"s.{k}"))
        joined = t.join(s, keys, "full" if insert else "left")
        hit = F.col("__t") & F.col("__s") & (F.lit(True) if when_matched is None else F.coalesce(when_matched, F.lit(False)))
        values = values or {c: F.col(f"s.{c}") for c in source.columns if c in target.columns and c not in on}
        out = []
        for f in target.schema:
            old = F.col(f"t.{f.name}")
            new = F.col(f"s.{f.name}") if f.name in source.columns else F.lit(None)
            kept = F.when(hit, values[f.name]).otherwise(old) if f.name in values else old
            out.append(F.when(F.col("__t"), kept).otherwise(new).cast(f.dataType).alias(f.name))
        return joined.select(*out)

    def merge(self, source: DataFrame, on: Sequence[str], **how) -> int:
        return self.commit(self.merged(source, on, **how), operation="MERGE")


class Transaction:
    """Commits to several tables that are seen together or, if the block raises, not at all.

    A commit that another writer has got ahead of raises ``CommitConflict``, and none of the transaction's is seen.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.manifest, self.files = f"{root.rstrip('/')}/_transactions/{uuid.uuid4().hex}.json", Files(spark, root)
        self.staged: list[tuple[VersionedTable, str, str]] = []

    def __enter__(self) -> Transaction:
        return self

    def commit(self, table: VersionedTable, df: DataFrame, mode: str = "overwrite", operation: str | None = None) -> None:
        if any(t.path == table.path for t, _, _ in self.staged):
            raise ValueError("one commit a table")
        self.staged.append((table, *table.stage(df, mode, operation, manifest=self.manifest)))

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            for table, path, text in self.staged:
                table.files.publish(path, text)
            self.files.publish(self.manifest, json.dumps({"state": COMMITTED, "entries": [path for _, path, _ in self.staged]}))  # fails if a writer gave it up
            for table, _, text in self.staged:
                table.seen = json.loads(text)["version"]
