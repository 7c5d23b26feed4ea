"""Tool calls, toxicity, top-k, quality, mixing and the pipeline against brute force, oracles and planted cases."""

from __future__ import annotations

import glob
import json
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakemill.llm import jaccard, mixing, packing, pii, quality, suffixes, toolcalls, topk, toxicity
from lakemill.llm.catalogue import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
CLASHES = ("row", "n", "at", "salt", "name", "target", "copies", "key", "doc", "evidence", "__text", "host", "path", "chosen", "draw")


def frame(spark, rows, schema="doc_id long, text string, lang string, source string", extra=False):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- oracles ---------------------------------------------------------------------------------------------------------


@tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    told = con.execute(ORACLES[name])
    names = [x[0] for x in told.description]
    found = QUERIES[name](spark, SF_DIR)
    assert sorted(names) == sorted(found.columns)
    assert rows_of(found, *names) == sorted(told.fetchall(), key=repr)


# --- tool calls ------------------------------------------------------------------------------------------------------


def call(**x):
    return f"<tool_call>{json.dumps(x)}</tool_call>"


def result(**x):
    return f"<tool_result>{json.dumps(x)}</tool_result>"


def test_calls_are_linked_ordered_and_checked(spark):
    tools = '<tools>[{"name":"add","parameters":{"type":"object","required":["a"],"properties":{"a":{"type":"integer"}}}}]</tools>'
    turns = [
        (1, 0, "system", "x" + tools),
        (1, 1, "assistant", call(id="c", name="add", arguments={"a": {"$ref": "b"}}) + call(id="b", name="add", arguments={"a": {"$ref": "a"}}) + call(id="a", name="add", arguments={"a": 2.0, "z": 1})),
        (1, 2, "tool", result(id="a", content={"v": 1.0}) + result(id="a", content=2) + result(id="zz", content=1)),
        (1, 3, "assistant", call(id="a", name="add", arguments={"a": 1}) + call(id="d", name="add", arguments={"a": "x"}) + call(id="e", name="other", arguments={})),
        (2, 0, "tool", result(id="x", content=0)),
        (2, 1, "assistant", call(id="x", name="f", arguments=[{"$ref": "y"}]) + call(id="y", name="f", arguments=[{"$ref": "x"}]) + "<tool_call>{bad</tool_call>" + call(name="no id") + call(id="w", name="f", arguments={"q": {"$ref": "nowhere"}})),
        (2, 2, "user", call(id="u", name="f", arguments={})),
        (3, 0, None, None),
        (None, 0, "assistant", call(id="n", name="f", arguments={}) + "<tool_call>open"),
        (None, 1, "tool", result(id="n", content=1)),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("row", "id", "kind", "level", "status")})
    messages, calls, results = toolcalls.link(df)
    assert rows_of(calls.where("conv_id = '1'"), "turn", "id", "status", "level", "violation") == sorted(
        [(1, "a", "linked", 0, None), (1, "b", "unanswered", 1, None), (1, "c", "unanswered", 2, None), (3, "a", "duplicate", None, None), (3, "d", "unanswered", 0, "$.a: not integer"), (3, "e", "unanswered", 0, "unknown tool")], key=repr
    )
    assert rows_of(calls.where("conv_id = '2'"), "id", "status", "level") == sorted([("x", "unanswered", -1), ("y", "unanswered", -1), (None, "malformed", None), (None, "malformed", None), ("w", "unanswered", 0)], key=repr)
    assert rows_of(results, "conv_id", "id", "status") == sorted([("1", "a", "linked"), ("1", "a", "duplicate"), ("1", "zz", "orphan"), ("2", "x", "orphan"), (None, "n", "orphan")], key=repr)
    made = {(r["conv_id"], r["turn"]): r for r in toolcalls.format_chat(df).collect()}
    assert len(made) == len(turns)
    assert json.loads(made["1", 1]["message"])["tool_calls"][2]["result"] == {"v": 1} and '"arguments":{"a":2,"z":1}' in made["1", 1]["message"]
    assert json.loads(made["2", 2]["message"])["content"].startswith("<tool_call>")
    assert made["3", 0]["message"] == '{"content":"","role":null}'
    assert toolcalls.format_chat(df.limit(0)).count() == 0


def test_canonical_json_is_one_text_for_equal_values():
    rng = random.Random(1)

    def value(depth=0):
        kind = rng.randrange(6 if depth < 3 else 4)
        if kind == 4:
            return [value(depth + 1) for _ in range(2)]
        if kind == 5:
            return {rng.choice("bca🙂"): value(depth + 1) for _ in range(3)}
        return [None, rng.random() < 0.5, rng.randrange(5), rng.choice("aé🙂")][kind]

    for _ in range(100):
        x = value()
        assert json.loads(toolcalls.canonical(x)) == x
        assert toolcalls.canonical(json.loads(json.dumps(x))) == toolcalls.canonical(x)
    assert toolcalls.canonical({"b": 1.0, "a": [1e300, -0.5]}) == '{"a":[1e+300,-0.5],"b":1}'
    with pytest.raises(ValueError):
        toolcalls.canonical(math.nan)


@pytest.mark.parametrize(
    ("value", "schema", "ok"),
    [
        (3, {"type": "integer", "minimum": 3}, True), (2, {"minimum": 3}, False), (2.0, {"type": "integer"}, True), (True, {"type": "number"}, False), ("abc", {"maxLength": 2}, False),
        ({"a": 1}, {"additionalProperties": False, "properties": {}}, False), ([1, "x"], {"items": {"type": "integer"}}, False), ("x", {"enum": ["x", 1]}, True), (None, {"type": ["string", "null"]}, True),
        ({}, {"required": ["k"]}, False), ({"$ref": "c"}, {"type": "string"}, True), (1, {"const": 1.0}, True), (1, "no schema", True),
    ],
)
def test_schema_checks(value, schema, ok):
    assert (toolcalls.check(value, schema) is None) is ok


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_pairs_of_terms_decide(spark):
    """Neither word alone is toxic, both together are: additive weights cannot tell."""
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(1500):
        w = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(8)]
        kind = rng.randrange(4)
        w += [["plainly", "mildly"], ["insulting", "mildly"], ["plainly", "grouping"], ["insulting", "grouping"]][kind]
        rng.shuffle(w)
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(kind == 3)))
    docs, told = frame(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.learn(docs, told)
    found = {r["doc_id"]: r for r in toxicity.score(docs, machine).collect()}
    right = [found[i]["predicted"] == t for i, _, t in labels if found[i]["held_out"]]
    assert len(right) > 300 and np.mean(right) > 0.97
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found)
    odd = toxicity.score(frame(spark, [(1, None, None, None), (2, "", None, None), (None, "insulting grouping", None, None), (3, "word " * 20000, None, None)]), machine).collect()
    assert [r["predicted"] for r in odd if r["doc_id"] is not None] == [0, 0, 0] and all(0 <= r["score"] <= 1 for r in odd)
    flipped = told.where(toxicity.held_out(F.col("doc_id"))).withColumn("toxic", 1 - F.col("toxic")).unionByName(told.where(~toxicity.held_out(F.col("doc_id"))))
    assert np.array_equal(toxicity.learn(docs, flipped).weight, machine.weight)
    assert toxicity.score(docs, toxicity.learn(docs, told.limit(0))).where("predicted = 1").isEmpty()


# --- top-k -----------------------------------------------------------------------------------------------------------


def test_top_k_with_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(300)]
    vectors += [(1000 + i, [0.5] * 6) for i in range(400)]
    vectors += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2100, [1.0, 2.0]), (2200, []), (None, [1.0] * 6), (1005, [0.5] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(5)
    ready = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, v in sorted({i: v for i, v in ready if i % 100 == 0}.items()):
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ready if i != q and len(w) == len(v))[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    slack, topk.SLACK = topk.SLACK, 2
    try:
        for block in (4096, 3):
            found = topk.top_k(df, F.col("vec_id") % 100 == 0, query_block=block)
            assert sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in found.collect()) == expected
    finally:
        topk.SLACK = slack
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- quality ---------------------------------------------------------------------------------------------------------


def test_distinct_words_are_counted_over_the_whole_text():
    k = quality.FEATURES.index("distinct_words")
    opening, varied = [f"w{i}" for i in range(256)], [f"v{i % 256}" for i in range(1024)]
    share = lambda words: quality.features(" ".join(words).encode())[k]
    assert share(opening) == share(opening + varied) == 1 and share([]) == 0
    assert share(opening + ["round", "and"] * 512) == (256 + 4 * 2) / 1280
    assert share(["a", "b", "a"]) == 2 / 3


def test_quality_keeps_good_documents_and_shrinks_sparse_sites(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < (0.9 if i % 3 == 0 else 0.1)
        text = " ".join(rng.choice(["$$$", "!!", "|"]) + "x" for _ in range(30)) if bad else " ".join(f"word{rng.randrange(999)}" for _ in range(30))
        rows.append((i, text, "en", "junk" if i % 3 == 0 else f"site{i % 5}"))
        labels.append((i, int(not bad), 0))
    rows += [(5000, rows[1][1], "en", "seen once"), (5001, None, None, None), (5002, "", "de", "junk"), (5003, "word " * 30000, "en", None), (5003, "word " * 30000, "en", None)]
    docs, told = frame(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc"]["doc_id"]: r for r in quality.assess(docs, told).collect()}
    assert np.mean([found[i]["keep"] == bool(q) for i, q, _ in labels]) > 0.99
    rate = np.mean([q for _, q, _ in labels])
    assert found[0]["host_posterior"] < 0.3 < found[1]["host_posterior"]
    assert abs(found[5000]["host_posterior"] - rate) < abs(found[1]["host_posterior"] - rate)
    assert quality.keep_good(docs, told).columns == docs.columns
    assert quality.assess(docs, told).count() == len(rows)
    assert quality.assess(docs.limit(0), told).count() == 0
    assert {r["evidence"] for r in quality.assess(docs, told.limit(0)).collect()} == {0.0}


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_targets_are_shared_as_by_hand(spark):
    rng = random.Random(9)
    for _ in range(6):
        sizes = {f"s{i}": rng.choice((0, 1, 10, 1000, 10**6)) for i in range(rng.randint(1, 7))} | {None: 50}
        names = sorted((n for n in sizes if n is not None)) + [None]
        weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
        total, goal = sum(sizes.values()), {}
        while True:
            free = [n for n in names if n not in goal]
            left = total - sum(goal.values())
            level = left / max(sum(weight[n] for n in free), 1)
            over = [n for n in free if level * weight[n] > 3 * sizes[n]]
            if not over:
                goal |= {n: level * weight[n] for n in free}
                break
            goal |= {n: 3 * sizes[n] for n in over}
        found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
        for r in found.collect():
            assert r["target"] == pytest.approx(goal[r["source"]]), (sizes, r)


def test_mix_is_near_its_targets_and_the_same_again(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice((1, 5, 50, 300))), "en", rng.choice(["a", "a", "a", "b", "c", None, "Ω"])) for i in range(1500)]
    rows += [(9000, None, "en", "a"), (9001, " \n", "en", "empty"), (9002, "x " * 5000, "en", "b"), (9003, "w w", "en", "a"), (9003, "w w", "en", "a"), (None, "w", "en", "b")]
    docs = frame(spark, rows, extra=True)
    split = mixing.sample_counts(docs, cell_rows=100).toPandas()
    whole = mixing.sample_counts(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "source_size", "target", "copies"]
    assert split[key].sort_values(key).values.tolist().__repr__() == whole[key].sort_values(key).values.tolist().__repr__()
    assert whole["copies"].between(0, 3).all() and len(whole) == len(rows)
    for _, s in whole.groupby("source_size"):
        assert abs((s["size"] * s["copies"]).sum() - s["target"].iloc[0]) <= max(0.03 * s["target"].iloc[0], 2 * s["size"].max())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counted = whole.groupby("doc_id", dropna=False)["copies"].sum()
    got = mixed.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert {k: v for k, v in counted.items() if v} == dict(got.items()) or str(sorted((str(k), int(v)) for k, v in counted.items() if v)) == str(sorted((str(k), int(v)) for k, v in got.items()))
    assert mixing.sample_counts(docs.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------


@tables
def test_pipeline_against_its_parts_by_brute_force(spark):
    import corpus_pipeline
    import public_tokenizers
    from test_text_operators import brute_components, brute_spans

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources", "packing"]
    whole = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    small = whole.where("doc_id < 120").cache()  # a fixture of the test, whose brute force is quadratic
    docs, kept = small, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF_DIR).cache()
        assert docs.columns == whole.columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc"]["doc_id"] for r in quality.assess(small, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect() if r["keep"]}
    assert set(kept[names[0]]) == good
    first = {doc for doc, _, component in brute_components([(i, r["text"]) for i, r in sorted(kept[names[0]].items())], 5, 80) if doc == component}
    assert set(kept[names[1]]) == first
    assert set(kept[names[2]]) == first and not any(brute_spans(r["text"]) for r in kept[names[2]].values())
    assert all(r["n_chars"] == len(r["text"]) for r in kept[names[2]].values())
    assert set(kept[names[3]]) <= first
    words = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF_DIR).toPandas()
    assert packed["length"].sum() == sum(len(words.encode(r["text"])) // 4 + 1 for r in docs.collect())
    assert pii.KINDS == ("email", "ip", "card", "phone")


# --- odd inputs and independent versions -----------------------------------------------------------------------------


def test_half_surrogates_and_odd_schemas_stop_nothing(spark):
    odd = [{"required": True}, {"enum": 3}, {"type": 7}, {"type": [1, "integer"]}, {"properties": [1]}, {"required": [1, "k"]}, {"items": 5, "minLength": "x"}, [], None]
    for schema in odd:
        for value in (1, "x", {"k": 1}, [1], None):
            toolcalls.check(value, schema)
    assert toolcalls.check(10**400, {"type": "integer", "minimum": 1.5}) is None and toolcalls.check({"a": 1}, {"properties": {"a": {"required": 1, "type": "string"}}}) == "$.a: not string"
    deep = "[" * 5000 + "]" * 5000
    turns = [
        (1, 0, "system", '<tools>[{"name":"f","parameters":{"required":true,"enum":1,"properties":[2]}}]</tools>'),
        (1, 1, "assistant", '<tool_call>{"id":"a","name":"f","arguments":{"x":"\\ud800","\\udfff":1e400}}</tool_call>'),
        (1, 2, "assistant", '<tool_call>{"id":"b","name":"f","arguments":{"x":"\\ud800"}}</tool_call><tool_call>{"id":"\\ud800","name":"f"}</tool_call>'),
        (1, 3, "tool", '<tool_result>{"id":"b","content":"\\udead"}</tool_result>'),
        (1, 4, "assistant", f'<tool_call>{{"id":"d","name":"f","arguments":{deep}}}</tool_call>'),
        (1, 5, "assistant", '<tool_call>{"id":"e","name":"f","arguments":{"n":' + "9" * 400 + "}}</tool_call>"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = {r["turn"]: json.loads(r["message"]) for r in toolcalls.format_chat(df).collect()}
    assert [x["status"] for x in made[2]["tool_calls"]] == ["linked", "malformed"] and made[2]["tool_calls"][0]["result"] == "\udead"
    assert made[1]["tool_calls"][0]["status"] == "malformed" and made[4]["tool_calls"][0]["status"] in ("malformed", "unanswered")
    assert made[5]["tool_calls"][0]["arguments"] == {"n": int("9" * 400)}


def brute_chat(turns):
    """Statuses and levels of calls and results by plain loops, for well-formed blocks."""
    calls, results, level = {}, {}, {}
    place = sorted(range(len(turns)), key=lambda i: (turns[i][0] is not None, turns[i][0] or 0, turns[i][1], i))
    found, owners = [], {}
    for i in place:
        conv, turn, role, text = turns[i]
        for pos, (kind, key, name, body, refs, error) in enumerate(toolcalls.parse(role, text)[1]):
            found.append((conv, turn, i, pos, kind, key, refs))
    for conv, turn, i, pos, kind, key, refs in found:
        if kind == "call":
            first = conv is not None and (conv, key) not in owners
            if first:
                owners[conv, key] = (turn, i, pos, refs)
            calls[i, pos] = "unanswered" if first or conv is None else "duplicate"
    taken = set()
    for conv, turn, i, pos, kind, key, refs in found:
        if kind == "result":
            owner = owners.get((conv, key))
            if not owner or (turn, i, pos) < owner[:3]:
                results[i, pos] = "orphan"
            elif (conv, key) in taken:
                results[i, pos] = "duplicate"
            else:
                taken.add((conv, key))
                results[i, pos] = "linked"
                calls[owner[1], owner[2]] = "linked"
    for (conv, key), (_, i, pos, _) in owners.items():
        seen, depth = {key}, 0
        need = {r for r in owners[conv, key][3] if (conv, r) in owners}
        while need and depth <= len(owners):
            depth += 1
            need = {r for k in need for r in owners[conv, k][3] if (conv, r) in owners}
        level[i, pos] = depth if depth <= len(owners) else -1
    return calls, results, level


@pytest.mark.parametrize(("most", "hot"), [(20_000, 5000), (1, 2)])
def test_links_and_levels_are_those_of_plain_loops(spark, monkeypatch, most, hot):
    from lakemill.llm import common

    monkeypatch.setattr(toolcalls, "ORDERED", most)
    monkeypatch.setattr(toolcalls.levels, "__defaults__", (most,))
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(most)
    turns = []
    for conv in (1, 1, 1, 2, 3):
        for _ in range(25):
            key = f"k{rng.randrange(18)}"
            refs = {f"a{j}": {"$ref": f"k{rng.randrange(18)}"} for j in range(rng.choice((0, 0, 1, 2)))}
            block = call(id=key, name="f", arguments=refs) if rng.random() < 0.6 else result(id=key, content=1)
            turns.append((conv, len(turns), "assistant" if "tool_call" in block else "tool", block))
    for _ in range(20):
        turns.append((4, len(turns), "assistant", call(id=f"c{len(turns)}", name="f", arguments={"a": {"$ref": f"c{len(turns) - 1}"}})))
    df = spark.createDataFrame([(*t, i) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string, i long").coalesce(1)
    _, calls, results = toolcalls.link(df)
    by_turn = {t[1]: i for i, t in enumerate(turns)}
    wanted_calls, wanted_results, wanted_levels = brute_chat(turns)
    rows = calls.collect()
    assert {(by_turn[r["turn"]], r["pos"]): r["status"] for r in rows} == wanted_calls
    assert {(by_turn[r["turn"]], r["pos"]): r["status"] for r in results.collect()} == wanted_results
    assert {(by_turn[r["turn"]], r["pos"]): r["level"] for r in rows if r["level"] is not None} == wanted_levels


@pytest.mark.parametrize("share", [1.0, 0.2])
def test_exclusive_or_of_two_words_is_learnt(spark, share):
    """Neither word tells anything alone: toxic are documents that have just one of them."""
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(int(2000 / max(share, 0.4))):
        w, told = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(8)], 0
        if rng.random() < share:
            kind = rng.randrange(4)
            w += ["group"] * (kind & 1) + ["remark"] * (kind >> 1)
            told = int(kind in (1, 2)) if share == 1 else int(kind == 3)
        rng.shuffle(w)
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, told))
    docs, told = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.learn(docs, told)).collect()}
    right = [found[i]["predicted"] == t for i, _, t in labels if found[i]["held_out"]]
    assert np.mean(right) > 0.95


def test_fits_do_not_depend_on_which_repeated_row_comes_first(spark):
    rng = random.Random(3)
    rows = [(i % 40, " ".join(rng.choices(["good", "bad", "worse", "words"], k=6)), "en", "s") for i in range(120)]
    told = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    a, b = frame(spark, rows), frame(spark, rows[::-1]).repartition(5)
    assert np.array_equal(toxicity.learn(a, told).weight, toxicity.learn(b, told).weight)
    assert np.array_equal(quality.learn(a, told)[0].weight, quality.learn(b, told)[0].weight)
    assert toxicity.score(a.limit(0), toxicity.learn(a, told)).count() == 0


def test_top_k_of_vectors_of_any_size(spark):
    rng = random.Random(6)
    sizes = [1.0, 1e6, 1e15, 1e100, 1e300]
    vectors = [(i, [rng.uniform(-1, 1) * rng.choice(sizes) for _ in range(3)]) for i in range(210)] + [(900, [1e308, 0.0, 0.0]), (1000, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    ready = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if all(math.isfinite(1024 * x) for x in v)]
    expected = []
    for q, v in sorted((i, v) for i, v in ready if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ready if i != q)[:10]
        expected += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(scores)]
    found = topk.top_k(df, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in found.collect()) == expected


def brute_sites(scored, rate_prior):
    """Posteriors of (host, path, evidence) rows by loops over sites, each document without its own evidence."""
    logistic = lambda x: 1 / (1 + math.exp(-x))
    p = [logistic(e + math.log(rate_prior / (1 - rate_prior))) for _, _, e in scored]

    def strength(groups):
        chance = sum(m * (1 - m) for _, _, m in groups)
        gap = sum((g / n - m) ** 2 * n for n, g, m in groups)
        total = sum(n for n, _, _ in groups)
        if len(groups) < 2 or total <= len(groups):
            return 1e6
        between = max((gap - chance) / total, 0)
        within = sum(m * (1 - m) * n for n, _, m in groups) / total
        return min(max(within / between - 1, 1), 1e6) if between > 0 else 1e6

    def sums(key):
        out = {}
        for (h, s, _), x in zip(scored, p, strict=True):
            n, g = out.get(key(h, s), (0, 0.0))
            out[key(h, s)] = n + 1, g + x
        return out

    hosts, paths = sums(lambda h, s: h), sums(lambda h, s: (h, s))
    rate = min(max((sum(p) + rate_prior) / (len(p) + 1), 0.001), 0.999)
    w_host = strength([(n, g, rate) for n, g in hosts.values()])
    w_path = strength([(n, g, (hosts[h][1] + w_host * rate) / (hosts[h][0] + w_host)) for (h, _), (n, g) in paths.items()])
    out = []
    for (h, s, e), x in zip(scored, p, strict=True):
        host = min(max((hosts[h][1] - x + w_host * rate) / (hosts[h][0] - 1 + w_host), 0.001), 0.999)
        path = min(max((paths[h, s][1] - x + w_path * host) / (paths[h, s][0] - 1 + w_path), 0.001), 0.999)
        out.append((host, path, logistic(e + math.log(path / (1 - path)))))
    return out


@pytest.mark.parametrize(("most", "hot"), [(50_000, 5000), (0, 3)])
def test_posteriors_are_those_of_plain_sums(spark, monkeypatch, most, hot):
    from lakemill.llm import common

    monkeypatch.setattr(quality, "SITES", most)
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(4)
    sites = [("a|=b", "c"), ("a", "b|=c"), ("a", None), (None, "c"), ("", "c"), ("a", "")]
    rows = [(i, " ".join(rng.choices(["$$$x", "!!", "word", "other", "text"], k=12)), lang, source) for i in range(300) for source, lang in [sites[min(rng.randrange(9), 5)]]]
    labels = spark.createDataFrame([(i, int("$$$x" not in t), 0) for i, t, _, _ in rows], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows, extra=True)
    _, prior = quality.learn(docs, labels)
    found = sorted(quality.assess(docs, labels).collect(), key=lambda r: r["doc"]["doc_id"])
    assert len(found) == len(rows)
    expected = brute_sites([(r["doc"]["source"], r["doc"]["lang"], r["evidence"]) for r in found], prior)
    for r, (host, path, good) in zip(found, expected, strict=True):
        assert (r["host_posterior"], r["path_posterior"], r["quality"]) == pytest.approx((host, path, good)) and r["keep"] == (r["quality"] >= quality.THRESHOLD)


def test_a_class_of_many_rows_is_cut_into_cells(spark):
    rows = [(i, "w w", "en", "a") for i in range(400)] + [(1000 + i, "w " * (i % 30), "en", "b") for i in range(300)]
    docs = frame(spark, rows)
    whole = rows_of(mixing.sample_counts(docs, cell_rows=10**6), "doc_id", "size", "source_size", "target", "copies")
    branch, mixing.BRANCH = mixing.BRANCH, 3
    try:
        assert rows_of(mixing.sample_counts(docs.repartition(6), cell_rows=7), "doc_id", "size", "source_size", "target", "copies") == whole
    finally:
        mixing.BRANCH = branch


def brute_mix(rows):
    """Copies of (doc_id, size, source) rows: targets by water filling, then one walk along each source."""
    import hashlib

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    goal, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in goal]
        level = (total - sum(goal.values())) / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if 3 * sizes[s] < level * weight[s]]
        if not over:
            goal |= {s: level * weight[s] for s in free}
            break
        goal |= {s: 3 * sizes[s] for s in over}
    out = []
    for s in names:
        rate = goal[s] / sizes[s] if sizes[s] else 0.0
        at = int(md5("0|" + (s or ""))[:4], 16) / 65536
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (len(str(r[1])) * 1000 + int(str(r[1])[:3]), md5(str(r[0])), r[1], r[0]))
        for i, (doc, n, _) in enumerate(mine, 1):
            out.append((doc, min(math.floor(i * rate + at) - math.floor((i - 1) * rate + at), 3)))
    return dict(out)


@tables
def test_pipeline_run_on_whole_tables_by_brute_force(spark):
    import re

    import corpus_pipeline
    import public_tokenizers
    from test_text_operators import brute_components, brute_spans, brute_terms

    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    classifier, prior = quality.learn(docs, labels)
    evidence = classifier.evidence(np.array([quality.features((r["text"] or "").encode()) for r in rows]))
    judged = brute_sites([(r["source"], r["lang"], float(e)) for r, e in zip(rows, evidence, strict=True)], prior)
    rows = [r for r, (_, _, good) in zip(rows, judged, strict=True) if good >= quality.THRESHOLD]
    alone = {doc for doc, _, component in brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80) if doc == component}
    texts = [(r["doc_id"], r["text"], r["source"]) for r in rows if r["doc_id"] in alone]
    terms, clean = brute_terms([(doc, text) for doc, text, _ in texts]), []
    for row, (doc, text, source) in enumerate(texts):
        marks = sorted([(s, e, f"[{k.upper()}]") for k, s, e in brute_spans(text)] + [(s, e, "" if gone else "[TERM]") for s, e, gone in terms[row]])
        out, at = [], 0
        for s, e, by in marks:
            if s >= at:
                out += [text[at:s], by]
            at = max(at, e)
        clean.append((doc, "".join(out) + (text or "")[at:] if text is not None else None, source))
    copies = brute_mix([(doc, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), source) for doc, text, source in clean])
    words = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    expected = {doc: (copies[doc], len(words.encode(text or "")) // 4 + 1) for doc, text, _ in clean if copies[doc]}
    found = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert found.groupby("sequence_id")["length"].sum().max() <= packing.WINDOW
    got = {doc: (int(round(s["length"].sum() / s["doc_tokens"].iloc[0])), int(s["doc_tokens"].iloc[0])) for doc, s in found.groupby("doc_id")}
    assert got == expected


@tables
def test_stages_take_odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, empty tables and names that the stages use themselves."""
    import corpus_pipeline

    long = " ".join(f"plain words of a long text {i % 977} end," for i in range(30_000))
    rows = [(1, "A plain text of words that is long enough to be judged.", "en", "a"), (1, "A plain text of words that is long enough to be judged.", "en", "a"), (2, None, None, None), (None, "mail me at some.body@mail.example or +1 212 555 0100", None, "b"), (None, None, None, None), (3, "", "", ""), (4, long, "en", "a"), (5, long + " more", "en", "a"), (6, " \n\t ", "de", None)]
    docs = frame(spark, rows, extra=True).withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("y") for c in ("spans", "some", "flagged", "gone", "host", "no_path", "order_key", "class_rows", "kind", "hit")})
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF_DIR)
        out = found.collect()
        if name != "packing":
            assert found.columns == docs.columns
            assert all(r["key"] == "x" and r["spans"] == "y" and r["n_chars"] == (r["text"] if r["text"] is None else len(r["text"])) for r in out)
        told = sorted(str(r["doc_id"]) for r in out)
        if name == "PII":
            assert told == sorted(str(r[0]) for r in rows) and {r["text"] for r in out if r["text"] and "mail" in r["text"]} == {"mail me at [EMAIL] or [PHONE]"}
        if name == "n-gram Jaccard join":
            assert told == sorted(["1", "1", "2", "None", "None", "3", "4", "6"])
        if name == "packing":
            assert {r["doc_id"] for r in out} == {1, 2, 3, 4, 5, 6, None} and sum(r["length"] for r in out if r["doc_id"] == 2) == 1
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_long_texts_are_read_whole(spark):
    """What decides stands at the far end of texts of some megabytes."""
    filler = " ".join(f"word{i % 5003}" for i in range(400_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"{filler} {passage} insulting", "en", "s"), (2, f"{passage} other", "en", "s"), (3, filler, "en", "s")]
    docs = frame(spark, rows)
    found = [tuple(r) for r in suffixes.repeats(docs.where("doc_id <> 3")).where("NOT first").select("doc_id", "n_words").collect() if r["n_words"] == 60]
    assert found == [(2, 60)]
    linked = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert linked[1][1] == linked[3][1] == 1 and linked[2] == (57, 2)
    labels = [(100 + i, 1, i % 2) for i in range(200)]
    texts = [(100 + i, "insulting words" if i % 2 else "other words", "en", "s") for i in range(200)]
    machine = toxicity.learn(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, machine).collect()} == {1: 1, 2: 0, 3: 0}


def test_empty_tables_give_no_rows(spark):
    none = frame(spark, [(1, "a", "en", "s")], extra=True).limit(0)
    assert pii.sanitise(none).count() == 0 and mixing.mix(none).count() == 0 and jaccard.keep_first(none).count() == 0
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(none, labels).count() == 0 and quality.assess(none, labels.limit(0)).count() == 0
