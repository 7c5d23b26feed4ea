"""Chat formatting: tool calls linked to results, ordered by dependency, checked against schemas, as canonical JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import common

#: Blocks in a text and the roles that may hold them; the body is JSON.
#: call: {"id", "name", "arguments"}; result: {"id", "content"}; tools: [{"name", "parameters": JSON schema}].
BLOCKS = {"assistant": ("tool_call", "call"), "tool": ("tool_result", "result"), "system": ("tools", "tool")}
#: An argument {"$ref": id} stands for the result of that call, which must come first.
REF = "$ref"
#: Calls with needs that one task puts into order at most; larger conversations are ordered round by round.
ORDERED = 20_000

_HALVES = re.compile("[\ud800-\udfff]")


def _plain(value: Any) -> Any:
    """Whole floats as integers and object keys in the order of their UTF-16 code units."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    return [_plain(x) for x in value] if isinstance(value, list) else value


def _escaped(text: str) -> str:
    """Half surrogate pairs, which no UTF-8 text can have, as JSON escapes."""
    return _HALVES.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value: Any) -> str:
    """One text for equal values: sorted keys, no spaces, whole numbers without a point, no NaN; always valid UTF-8."""
    return _escaped(json.dumps(_plain(value), separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


_KINDS = {
    "object": lambda x: isinstance(x, dict), "array": lambda x: isinstance(x, list), "string": lambda x: isinstance(x, str), "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None, "number": _number, "integer": lambda x: _number(x) and (isinstance(x, int) or x.is_integer()),
}


def check(value: Any, schema: Any, at: str = "$") -> str | None:
    """The first violation of a JSON schema, or None. A reference to another call's result fits any schema.

    Knows type, enum, const, properties, required, additionalProperties, items, minimum, maximum, minLength, maxLength,
    minItems and maxItems; other keywords are ignored, and so is a keyword whose value
    is not of its kind, and what is no schema.
    """
    if schema is False:
        return f"{at}: nothing is allowed"
    if not isinstance(schema, dict) or (isinstance(value, dict) and set(value) == {REF}):
        return None
    kinds = schema.get("type")
    kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
    if kinds and not any(_KINDS.get(k, lambda _: True)(value) for k in kinds):
        return f"{at}: not {' or '.join(kinds)}"
    if isinstance(schema.get("enum"), list) and canonical(value) not in map(canonical, schema["enum"]):
        return f"{at}: not one of enum"
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return f"{at}: not const"
    size = len(value) if isinstance(value, str | list) else None
    least, most = (("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")) if size is not None else ("minimum", "maximum")
    amount = size if size is not None else value if _number(value) else None
    if amount is not None:
        if _number(schema.get(least)) and amount < schema[least]:
            return f"{at}: under {least}"
        if _number(schema.get(most)) and amount > schema[most]:
            return f"{at}: over {most}"
    if isinstance(value, dict):
        known, needed = schema.get("properties"), schema.get("required")
        known = known if isinstance(known, dict) else {}
        for k in needed if isinstance(needed, list) else []:
            if isinstance(k, str) and k not in value:
                return f"{at}: {k} is missing"
        for k in sorted(value):
            if found := check(value[k], known.get(k, schema.get("additionalProperties", True)), f"{at}.{k}"):
                return found
    if isinstance(value, list):
        for i, x in enumerate(value):
            if found := check(x, schema.get("items", True), f"{at}[{i}]"):
                return found
    return None


def violation(body: str, schema: str) -> str | None:
    """The first violation of canonical JSON of a canonical JSON schema."""
    try:
        found = check(json.loads(body), json.loads(schema))
    except RecursionError:
        return "$: nested too deeply to check"
    return None if found is None else _escaped(found)


def references(value: Any) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {REF} and isinstance(value[REF], str):
            return {value[REF]}
        value = list(value.values())
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def _reject(x: str) -> None:
    raise ValueError(x)


def parse(role: str | None, text: str | None) -> tuple[str, list[tuple]]:
    """The text without its blocks, and (kind, id, name, body, references, error) for each block in order."""
    tag, kind = BLOCKS.get(role or "", (None, None))
    rest, found, at, text = [], [], 0, text or ""
    while tag and (begin := text.find(f"<{tag}>", at)) >= 0:
        if (end := text.find(f"</{tag}>", begin)) < 0:
            break
        rest.append(text[at:begin])
        body, at, before = text[begin + len(tag) + 2 : end], end + len(tag) + 3, len(found)
        try:
            value = json.loads(body, parse_constant=_reject)
            items = value if kind == "tool" and isinstance(value, list) else [value]
            for x in items:
                key = x.get("name" if kind == "tool" else "id") if isinstance(x, dict) else None
                if not isinstance(key, str) or _HALVES.search(key):
                    found.append((kind, None, None, canonical(x), [], "no name" if kind == "tool" else "no id"))
                elif kind == "call":
                    given = x.get("arguments", {})
                    name = x.get("name")
                    named = isinstance(name, str) and not _HALVES.search(name)
                    needs = sorted(r for r in references(given) if not _HALVES.search(r))
                    found.append((kind, key, name if named else None, canonical(given), needs, None if named else "no name"))
                elif kind == "result":
                    found.append((kind, key, None, canonical(x.get("content")), [], None))
                else:
                    found.append((kind, None, key, canonical(x.get("parameters", {})), [], None))
        except (ValueError, RecursionError):
            del found[before:]
            found.append((kind, None, None, None, [], "not JSON"))
    return "".join([*rest, text[at:]]), found


def _parsed(turns: DataFrame) -> DataFrame:
    """One record for each turn and each of its blocks, as a table in the shared folder."""
    names = ["row", "conv_id", "turn", "role", "kind", "pos", "id", "name", "body", "refs", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rest, blocks = parse(role, text)
                out.append((row, conv, turn, role, "message", -1, None, None, rest, [], None))
                out += [(row, conv, turn, role, kind, i, *more) for i, (kind, *more) in enumerate(blocks)]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    rows = turns.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    schema = "row long, conv_id string, turn long, role string, kind string, pos int, id string, name string, body string, refs array<string>, error string"
    return common.cut(rows.mapInArrow(common.task("none", run), schema), "parsed")


def ordered(needs: list[tuple[str, str]]) -> dict[str, int]:
    """The level of each call that needs another, from (call, need): one more than the highest it needs, -1 on or past a cycle."""
    wanted: dict[str, int] = {}
    users: dict[str, list[str]] = {}
    for call, need in set(needs):
        wanted[call] = wanted.get(call, 0) + 1
        users.setdefault(need, []).append(call)
    level = dict.fromkeys(wanted, -1)
    ready, depth = [x for x in users if x not in wanted], 0
    while ready:
        depth, then = depth + 1, []
        for need in ready:
            for call in users.get(need, ()):
                wanted[call] -= 1
                if not wanted[call]:
                    level[call] = depth
                    then.append(call)
        ready = then
    return level


def levels(calls: DataFrame, edges: DataFrame, most: int = ORDERED) -> DataFrame:
    """(conv_id, id, level): 0 for calls that need no other, else one more than the highest they need; -1 on or past a cycle.

    The needs of a conversation that has at most ``most`` are put into order in one task, by taking calls whose needs
    are all met. Those of larger conversations are taken in rounds over all tasks, as many as the longest chain has
    calls; without such a conversation there is none.
    """
    key = ["conv_id", "id"]
    edges = common.cut(edges.select(*key, "needs").distinct(), "needs")
    sizes = common.cut(edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    small = common.hot_join(edges, sizes.where(F.col("n") <= most), ["conv_id"], "n", "id", "needs")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = ordered(list(zip(frame["id"], frame["needs"], strict=True)))
        return pd.DataFrame({"conv_id": frame["conv_id"].iloc[0], "id": list(found), "level": np.array(list(found.values()), np.int32)})

    done = [small.groupBy("conv_id").applyInPandas(run, "conv_id string, id string, level int")]
    large = common.cut(sizes.where(F.col("n") > most), "large")
    if not large.isEmpty():
        edges = common.cut(common.hot_join(edges, large, ["conv_id"], "n", "id", "needs").drop("n"), "needs")
        left, level = common.cut(edges.select(*key).distinct(), "left"), 1
        met = edges.select("conv_id", F.col("needs").alias("id")).distinct().join(left, key, "left_anti")
        while True:
            edges = common.cut(edges.join(met.select("conv_id", F.col("id").alias("needs")), ["conv_id", "needs"], "left_anti"), "needs")
            met = common.cut(left.join(edges, key, "left_anti"), "ready")
            if met.isEmpty():
                break
            done.append(met.withColumn("level", F.lit(level)))
            left, level = common.cut(left.join(met, key, "left_anti"), "left"), level + 1
        done.append(left.withColumn("level", F.lit(-1)))
    told = done[0]
    for more in done[1:]:
        told = told.unionByName(more)
    told = calls.select(*key).join(common.cut(told, "ordered"), key, "left")
    return told.withColumn("level", F.coalesce("level", F.lit(0)))


def _violations(calls: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for body, schema in zip(batch.column("body").to_pylist(), batch.column("schema").to_pylist(), strict=True):
                told.append(None if schema is None or body is None else violation(body, schema))
            yield batch.append_column("violation", pa.array(told, pa.string()))

    return calls.mapInArrow(common.task("none", run), calls.withColumn("violation", F.lit(None).cast("string")).schema)


def _first(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``first``: true for the earliest of each key. Minima are aggregated before the shuffle."""
    place = F.struct("turn", "row", "pos")
    least = rows.groupBy(*key).agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("rows"))
    found = common.hot_join(rows, common.cut(least, "least"), key, "rows", "row", "pos", how="left")
    return found.withColumn("first", F.coalesce(place == F.col("least"), F.lit(False))).drop("least", "rows")


def link(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, calls, results) of ``turns`` (conv_id, turn, role, text).

    A call and a result of one conversation are hash-joined by identifier. The first call with an identifier owns
    it, and the first result after the call is its result. Status of calls: linked, unanswered, duplicate or
    malformed; of results: linked, orphan, duplicate or malformed. Calls carry their level in the order of needs
    and the first violation of their tool's first schema in the conversation, or "unknown tool" if others are
    declared there.
    """
    parsed = _parsed(turns)
    of = lambda kind: parsed.where(F.col("kind") == kind)
    key = ["conv_id", "id"]
    calls = _first(of("call").select("row", "conv_id", "turn", "pos", "id", "name", "body", "refs", "error"), key)
    owners = common.cut(calls.where("first AND error IS NULL"), "calls")
    results = of("result").select("row", "conv_id", "turn", "pos", "id", "body", "error")
    when = owners.select(*key, F.struct("turn", "row", "pos").alias("called"))
    asked = results.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    when = common.cut(when.join(asked, key), "called")  # calls that have a result at all, with how many
    met = common.hot_join(results, when, key, "rows", "row", "pos", how="left", hint="shuffle_hash").drop("rows").withColumn("after", F.coalesce(F.struct("turn", "row", "pos") > F.col("called"), F.lit(False)))
    late = _first(met.where("after").select("row", "conv_id", "turn", "pos", "id", "body"), key)
    answers = common.cut(late.where("first").select(*key, F.col("row").alias("result_row"), F.col("pos").alias("result_pos"), F.col("body").alias("result")), "answers")
    taken = answers.select(F.col("result_row").alias("row"), F.col("result_pos").alias("pos"), F.lit(True).alias("taken"))
    status = F.when(F.col("error").isNotNull(), F.lit("malformed")).when(F.col("taken"), F.lit("linked")).when(F.col("after"), F.lit("duplicate")).otherwise(F.lit("orphan"))
    results = met.join(taken, ["row", "pos"], "left").select("row", "conv_id", "turn", "pos", "id", "body", status.alias("status"))

    tools = _first(of("tool").where("error IS NULL").select("row", "conv_id", "turn", "pos", "name", F.col("body").alias("schema")), ["conv_id", "name"])
    tools = common.cut(tools.where("first").select("conv_id", "name", "schema"), "tools")
    used = owners.groupBy("conv_id", "name").agg(F.count(F.lit(1)).alias("rows"))
    calling = used.groupBy("conv_id").agg(F.sum("rows").alias("all_rows"))
    declared = common.cut(tools.select("conv_id").distinct().join(calling, "conv_id").withColumn("declared", F.lit(True)), "declared")
    tools = common.cut(tools.join(used, ["conv_id", "name"]), "used")
    needs = owners.select(*key, F.explode("refs").alias("needs")).join(owners.select("conv_id", F.col("id").alias("needs")), ["conv_id", "needs"], "left_semi")
    order = common.cut(levels(owners, needs), "levels")
    known = owners.select("row", "conv_id", "turn", "pos", "id", "name", "body", "refs")
    known = common.hot_join(known, tools, ["conv_id", "name"], "rows", "row", "pos", how="left").drop("rows")
    known = common.hot_join(_violations(known), declared, ["conv_id"], "all_rows", "row", "pos", how="left").drop("all_rows").join(order, key, "left").join(answers.hint("shuffle_hash"), key, "left")
    unknown = F.when(F.col("declared") & F.col("schema").isNull(), F.lit("unknown tool"))
    known = known.select("row", "pos", "level", "result", F.coalesce("violation", unknown).alias("violation"), F.col("result_row").isNotNull().alias("answered"), F.lit(True).alias("owner"))
    status = F.when(F.col("error").isNotNull(), F.lit("malformed")).when(F.col("owner").isNull(), F.lit("duplicate")).when(F.col("answered"), F.lit("linked")).otherwise(F.lit("unanswered"))
    calls = calls.join(known, ["row", "pos"], "left").select("row", "conv_id", "turn", "pos", "id", "name", F.col("body").alias("arguments"), "refs", status.alias("status"), "level", "violation", "result")
    messages = of("message").select("row", "conv_id", "turn", "role", F.col("body").alias("content"))
    return messages, calls, results


@common.tidy
def format_chat(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, counts of its calls and results by what came of them, and ``message``.

    ``message`` is canonical JSON with role, content and the turn's calls in their order, each with its level,
    status, violation and linked result. (level, turn, pos) is a topological order of a conversation's calls.
    Conversations are never gathered: joins are by call, and only the blocks of one turn are put together.

    Defined results: a null role or text is null or empty; a turn without blocks has no calls; a block that is not
    JSON or lacks its keys is malformed; calls on or past a cycle of needs have level -1; needs that name no call
    are met; a null conv_id links nothing; repeated turns repeat their calls, whose identifiers then are duplicates;
    an empty table gives no rows; other columns are ignored.
    """
    messages, calls, results = link(turns)
    told = F.struct("pos", "id", "name", "arguments", "status", "level", "violation", "result")
    per_turn = calls.groupBy("row").agg(F.sort_array(F.collect_list(told)).alias("calls"))
    count = lambda c: F.count_if(F.col("status") == c)
    answered = results.groupBy("row").agg(count("linked").alias("results_linked"), (F.count(F.lit(1)) - count("linked")).alias("results_unlinked"))
    rows = messages.join(per_turn, "row", "left").join(answered, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for role, content, found in zip(*(batch.column(c).to_pylist() for c in ("role", "content", "calls")), strict=True):
                # arguments and results are canonical already
                calls = [
                    f'{{"arguments":{x["arguments"] or "null"},"id":{canonical(x["id"])},"level":{canonical(x["level"])},"name":{canonical(x["name"])},'
                    f'"result":{x["result"] or "null"},"status":"{x["status"]}","violation":{canonical(x["violation"])}}}'
                    for x in found or ()
                ]
                out.append(f'{{"content":{canonical(content)},"role":{canonical(role)}' + (f',"tool_calls":[{",".join(calls)}]}}' if calls else "}"))
            yield batch.append_column("message", pa.array(out, pa.string()))

    made = rows.mapInArrow(common.task("none", run), rows.withColumn("message", F.lit("")).schema)
    of = lambda cond: F.coalesce(F.size(F.filter("calls", cond)), F.lit(0)).cast("long")
    return made.select(
        "conv_id", "turn", "role",
        of(lambda x: x["status"] == "linked").alias("calls_linked"),
        of(lambda x: x["status"] != "linked").alias("calls_unlinked"),
        of(lambda x: x["violation"].isNotNull()).alias("calls_invalid"),
        F.coalesce("results_linked", F.lit(0)).alias("results_linked"),
        F.coalesce("results_unlinked", F.lit(0)).alias("results_unlinked"),
        "message",
    )


def op2_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_chat(common.table(spark, sf_dir, "conversations"))
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))
