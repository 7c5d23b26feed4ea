"""Packing, media, Jaccard join, repeated passages and personal data against brute force on small rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakemill.llm import common, jaccard, media, packing, pii, suffixes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = [None, "", " \n\t ", "one", "two words", "Ünïcode ÄÖÜ é́ İ Σς 日本語 🙂 é <|endoftext|> <|ENDOFTEXT|>", "it's  they're,,, x.y!? $$$,\n a***", "word " * 5000, "x" * 30000, " nbsp em", "1 22 333 4,4.4"]


def frame(spark, rows, extra=False):
    """Documents in the order of ``rows`` of (doc_id, text); with columns that clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("row", "n", "start", "bucket", "node", "root", "key", "size", "copies", "doc")}) if extra else df


def docs_with_copies(seed=1, n=40, vocabulary=12, words=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out)[1].split()
            for _ in range(rng.choice((0, 1, 2, 4, 8))):
                if w:
                    w[rng.randrange(len(w))] = f"v{rng.randrange(vocabulary)}"
        else:
            w = [f"v{rng.randrange(vocabulary)}" for _ in range(rng.choice((1, 3, 12, 30, words, 2 * words)))]
        out.append((i, " ".join(w)))
    return [(rng.randrange(10**6) * 50 + i, t) for i, t in out]


# --- packing ---------------------------------------------------------------------------------------------------------


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(VOCABULARY), packing.WordTokens(VOCABULARY, limit=20)
    for text in [t or "" for t in ODD_TEXTS]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:50]


def test_best_fit_finds_the_tightest_window():
    rng = random.Random(0)
    for _ in range(50):
        lengths = np.array(sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 60))), reverse=True))
        window, offset = packing.best_fit_decreasing(lengths, 20)
        room, expected = [], []
        for n in lengths.tolist():
            fits = [(r, i) for i, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits)[1]] -= n
                expected.append(min(fits)[0])
            else:
                room.append(20 - n)
                expected.append(20)
        left = defaultdict(lambda: 20)
        for w, o, n, before in zip(window.tolist(), offset.tolist(), lengths.tolist(), expected, strict=True):
            assert o == 20 - left[w] and left[w] == before
            left[w] -= n
        assert len(left) == len(room)


def test_packing_covers_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (3, "one"), (3, "one")]
    for bucket_rows in (3, 1000):
        found = packing.pack(frame(spark, rows, extra=True), VOCABULARY, window=64, bucket_rows=bucket_rows).toPandas()
        assert found["length"].max() <= 64
        for _, s in found.sort_values("offset").groupby("sequence_id"):
            assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and s["length"].sum() <= 64
        words = packing.WordTokens(VOCABULARY)
        for doc, text in rows[: len(ODD_TEXTS)]:
            if doc == 3:
                continue
            ids = words.encode(text or "") + b"\x01\0\0\0"
            mine = found[found["doc_id"] == doc].sort_values("start")
            assert mine["length"].sum() * 4 == len(ids) and (mine["doc_tokens"] * 4 == len(ids)).all()
            assert [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(mine["start"], mine["length"], strict=True)] == mine["ids_crc32"].tolist()
        assert (found["doc_id"] == 3).sum() == 3 and found["doc_id"].isna().sum() == 1
    assert packing.pack(frame(spark, []), VOCABULARY).count() == 0


# --- media -----------------------------------------------------------------------------------------------------------


def test_media_hold_the_text_and_give_equal_features(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(99, ODD_TEXTS[7])]
    found = media.media_columns(frame(spark, rows, extra=True)).toPandas().set_index("doc_id")
    for i, text in rows:
        raw = (text or "").encode()
        padded = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        x = found.loc[i]
        samples, rate = media.read_wav(bytes(x["media"]))
        assert (samples, rate) == (padded, media.RATE)
        assert (x["n_bytes"], x["payload_bytes"], x["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert x["payload_sha256"] == hashlib.sha256(padded).hexdigest() and x["media_sha256"] == hashlib.sha256(bytes(x["media"])).hexdigest()
        assert len(x["fingerprint_times"]) == len(x["fingerprint_codes"]) and (np.diff(x["fingerprint_times"]) >= 0).all()
    assert found.loc[99]["feature"] == found.loc[7]["feature"]
    assert media.media_columns(frame(spark, [])).count() == 0


def test_peaks_of_a_tone_are_at_its_frequency():
    t = np.arange(media.FRAME * 20)
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8).tobytes()
    times, bins = media.peaks(tone)
    assert set(bins[(bins >= 12) & (bins < 36) & (times < 30)]) == {20}
    block, media.BLOCK = media.BLOCK, 3
    try:
        assert all((a == b).all() for a, b in zip(media.peaks(tone), (times, bins), strict=True))
    finally:
        media.BLOCK = block


# --- Jaccard join ----------------------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize(("k", "percent", "block", "seed"), [(3, 90, 10**6, 1), (5, 80, 10**6, 2), (1, 60, 10**6, 3), (2, 80, 60, 4)])
def test_jaccard_components(spark, k, percent, block, seed):
    rows = docs_with_copies(seed)
    if seed == 1:
        rows += [(7, None), (8, ""), (9, "Only two"), (10, "only TWO"), (None, rows[0][1]), (11, "z " * 3000), (11, "z " * 3000)]
    found = jaccard.near_duplicates(frame(spark, rows, extra=True).repartition(3), k, percent, block)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows, k, percent)


def test_no_signature_misses_a_link():
    rng = np.random.default_rng(5)
    for percent in (60, 80, 90):
        signatures = jaccard.Signatures(percent)
        for n in [*range(1, 60), 90, 250, 700]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
                most = len(a) * (100 - percent) // percent
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[: max(1, -(-len(a) * percent // 100))]], rng.integers(0, 1 << 63, rng.integers(0, most + 1), dtype=np.uint64) * 2]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                    assert len(np.intersect1d(signatures.of(a), signatures.of(b)))


def test_linked_sets_share_as_many_signatures_as_a_link_needs():
    rng = np.random.default_rng(9)
    for percent in (60, 80, 90):
        signatures = jaccard.Signatures(percent)
        for n in [*range(2, 60), 90, 250, 700]:
            for _ in range(4 if n > 20 else 200):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
                most = len(a) * (100 - percent) // percent
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[: max(1, -(-len(a) * percent // 100))]], rng.integers(0, 1 << 63, rng.integers(0, most + 1), dtype=np.uint64) * 2]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                    pairs = [(len(np.intersect1d(x, y)), max(p, q)) for i, x, p in signatures.kinds(a) for j, y, q in signatures.kinds(b) if (i, j) in ((0, 0), (1, 2), (2, 1))]
                    assert any(shared >= max(need, 1) for shared, need in pairs)


def test_common_passages_alone_make_no_candidates(spark):
    """A hundred documents of 300 words share one passage of 60: each shares too few signatures for any link."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(120)) + f" {passage} " + " ".join(f"v{i}x{j}" for j in range(120))) for i in range(100)]
    docs = frame(spark, rows).repartition(3)
    sets = jaccard.set_table(docs, 5)
    nodes = sets.groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("short").alias("short"))
    assert jaccard.candidates(docs, nodes, 5, 80).count() == 0


def test_merge_skip_counts_like_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(15), rng.randint(1, 10))) for _ in range(rng.randint(1, 8))]
        need = rng.randint(1, len(lists))
        expected = [(x, c) for x in range(15) if (c := sum(x in y for y in lists)) >= need]
        assert list(jaccard.merge_skip(lists, need)) == expected


def test_search_finds_every_link():
    rng = random.Random(4)
    for percent in (50, 80, 90):
        for _ in range(20):
            base = [set(rng.sample(range(60), rng.randint(1, 30))) for _ in range(4)]
            sets = [s for b in base for s in (b, (b - {rng.choice(sorted(b))}) | {rng.randrange(60)}, b | {rng.randrange(60)})]
            found = jaccard.search([np.array(sorted(s), np.uint64) for s in sets], percent)
            rows = brute_components([(i, " ".join(f"w{x}" for x in sorted(s))) for i, s in enumerate(sets)], 1, percent)
            assert [c for _, _, c in sorted(rows)] == found


def test_keep_first_keeps_one_of_each_group(spark):
    base = " ".join(f"v{i}" for i in range(60))
    rows = [(5, base), (3, base), (9, base + " more"), (1, "other text"), (None, base), (2, None)]
    kept = jaccard.keep_first(frame(spark, rows, extra=True))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 2, 3, None]
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [5, 400_000])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_are_those_of_a_plain_walk(spark, monkeypatch, most, kind):
    monkeypatch.setattr(common, "CONTRACTED", most)
    rng = random.Random(most)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)]
    name = (lambda x: x) if kind == "long" else lambda x: x.to_bytes(2, "big") + b"\0"
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"u {kind}, v {kind}").repartition(4)).collect()}
    reach = {}
    for a, b in edges:
        if a != b:
            both = reach.get(a, {a}) | reach.get(b, {b})
            reach |= dict.fromkeys(both, both)
    assert {name(a): name(min(both)) for a, both in reach.items()} == {bytes(k) if kind == "binary" else k: bytes(v) if kind == "binary" else v for k, v in found.items()}


def test_components_follow_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert found == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}


# --- repeated passages -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("length", "gram"), [(50, 8), (12, 4)])
def test_repeated_passages(spark, length, gram):
    rng = random.Random(length)
    passages = [[f"p{rng.randrange(10**6)}" for _ in range(n)] for n in (length - 1, length, length + 1, 3 * length)]
    rows = []
    for i in range(30):
        w = [f"u{rng.randrange(10**7)}" for _ in range(rng.randrange(2 * length))]
        for _ in range(rng.choice((0, 1, 2))):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((100 - i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "a " * (length - 1)), (503, "b " * (2 * length)), (504, rows[0][1]), (505, rows[0][1])]
    places = defaultdict(list)
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        for s in range(len(w) - length + 1):
            places[tuple(w[s : s + length])].append((doc, s))
    expected = defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for doc, s in at:
                expected[doc, (doc, s) == min(at)] |= set(range(s, s + length))
    found = defaultdict(set)
    for r in suffixes.repeats(frame(spark, rows, extra=True), length, gram).collect():
        assert r["n_words"] == r["end_word"] - r["start_word"] >= length
        assert not found[r["doc_id"], r["first"]] & set(range(r["start_word"], r["end_word"]))
        found[r["doc_id"], r["first"]] |= set(range(r["start_word"], r["end_word"]))
    assert dict(found) == dict(expected)
    assert suffixes.repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("batch", [3, 10000])
def test_runs_like_neither_neighbour_go_no_further(spark, batch):
    rng = random.Random(batch)
    rows = [(rng.choice((i - 500, 7, 8, rng.randrange(300))), i % 9, i, i, rng.choice((1, 1, 1, 2))) for i in range(1000)]
    copies = Counter(r[0] for r in rows)
    seen, expected = Counter(), {}
    for r in sorted(rows):
        seen[r[0]] += 1
        expected[r] = (seen[r[0]] > 1, seen[r[0]] < copies[r[0]])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        runs = spark.createDataFrame(rows, "hash long, doc_id long, row long, place long, n long").repartition(5)
        kept = suffixes.neighbours(runs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {tuple(r[c] for c in ("hash", "doc_id", "row", "place", "n")): (r["before"], r["after"]) for r in kept}
    assert len(found) == len(kept) and found == {r: expected[r] for r in found}
    alone = {r for r in rows if not any(expected[r]) and r[4] == 1}
    assert set(rows) - alone <= set(found)
    assert len(alone & set(found)) <= 8  # the first and the last of each of 4 tasks


# --- personal data ---------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def valid(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in hit.split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group())]


def test_base_spans(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "x.y%+z@d-e.f.g", "@", ".", "1.2.3.4", "999.1.1.1", "001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+", "12", " ", "é", "🙂", "\n", "-", "word", "5500000000000004", "(", "_"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(12)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "1" * 50000), (1003, "a." * 20000 + "@"), (1004, "+1" + " " * 30000), (1005, "1.2." * 9000), (1006, "x@y.z " * 300)]
    found = pii.find(pii.numbered(frame(spark, rows, extra=True))).collect()
    got = {r["doc_id"]: [(k, s["start"], s["end"]) for k in pii.KINDS for s in r[k]] for r in found}
    assert got == {i: brute_spans(t) for i, t in rows}
    assert pii.find(pii.numbered(frame(spark, []))).count() == 0


def test_terms_that_reveal_an_entity_go_with_it(spark):
    near = [(i, f"report by Zanzibarov of many common words, write to boss@corp.example or call {i}") for i in range(6)]
    rest = [(100 + i, "many common words and nothing else to report, write and call") for i in range(40)]
    found = {r["doc_id"]: r for r in pii.find(pii.numbered(frame(spark, near + rest))).collect()}
    text = near[0][1]
    words = {text[s["start"] : s["end"]] for s in found[0]["terms"]}
    assert not found[100]["terms"] and "common" not in words and not any(s["start"] <= text.index("boss") < s["end"] for s in found[0]["terms"])
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, near + rest, extra=True)).collect()}
    assert "[EMAIL]" in text[0] and "boss@" not in text[0] and text[100] == rest[0][1]


def test_terms_are_found_however_far_from_the_span(spark):
    filler = "many common words and nothing else to report, write and call " * 20
    near = [(i, f"Zanzibarov wrote {filler} to boss@corp.example") for i in range(8)]
    near += [(50 + i, "report by Quillonby of many common words, write to help@desk.example") for i in range(8)]
    rest = [(100 + i, filler) for i in range(400)]
    found = {r["doc_id"]: r for r in pii.find(pii.numbered(frame(spark, near + rest))).collect()}
    words = {i: {t[s["start"] : s["end"]] for s in found[i]["terms"]} for i, t in near + rest}
    assert words[0] >= {"Zanzibarov"} and words[50] >= {"Quillonby"} and not any(words[i] & {"many", "common", "words"} for i in words)
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, near + rest, extra=True)).collect()}
    assert not any("Zanzibarov" in t or "Quillonby" in t for t in text.values())


def test_terms_of_rare_entities_are_generalised_and_those_of_frequent_ones_removed(spark):
    filler = "many common words and nothing else to report, write and call"
    rows = [(1, f"Quillonby {filler} to help@desk.example"), *((10 + i, f"Zanzibarov {filler} to boss@corp.example") for i in range(20))]
    rows += [(100 + i, filler) for i in range(400)]
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, rows, extra=True)).collect()}
    assert text[1] == f"[TERM] {filler} to [EMAIL]" and text[10] == f" {filler} to [EMAIL]" and text[100] == filler


def test_terms_that_reveal_an_entity_go_everywhere(spark):
    filler = "many common words and nothing else to report, write and call"
    rows = [(i, f"ZANZIBAROV {filler} to boss@corp.example {f"{filler} " * 9} zanzibarov, (Zanzibarov)") for i in range(8)]
    rows += [(50, f"Zanzibarov {filler}"), *((100 + i, filler) for i in range(400))]
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["terms"]] for r in pii.find(pii.numbered(frame(spark, rows))).collect()}
    assert found == {i: [m.span() for m in re.finditer("(?i)zanzibarov", t)] for i, t in rows}
    assert not any("zanzibarov" in r["text"].lower() for r in pii.sanitise(frame(spark, rows, extra=True)).collect())


def test_sanitised_texts_keep_what_is_between(spark):
    rows = [(1, "mail a@b.cc, ip 1.2.3.4; end"), (2, None), (3, "clean"), (3, "clean")]
    cleaned = pii.sanitise(frame(spark, rows, extra=True))
    assert cleaned.columns == frame(spark, rows, extra=True).columns
    assert sorted(((r["doc_id"], r["text"]) for r in cleaned.collect()), key=repr) == [(1, "mail [EMAIL], ip [IP]; end"), (2, None), (3, "clean"), (3, "clean")]


# --- defined results and odd inputs ----------------------------------------------------------------------------------


def test_ids_of_every_white_space_and_separator_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(VOCABULARY), packing.WordTokens(VOCABULARY)
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or c < 33)]
    rng = random.Random(11)
    texts = [f"a{s}B{s}" for s in signs] + ["".join(rng.choices([*signs, "a", "B", "é", "12", ".", "'s"], k=rng.randrange(1, 30))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_full_windows_of_long_documents_are_not_gathered(spark):
    rows = [(1, "word " * 20000), (2, "one")]
    found = packing.pack(frame(spark, rows), VOCABULARY, window=64, bucket_rows=1).toPandas()
    assert (found["doc_id"] == 1).sum() == -(-20001 // 64) and found["sequence_id"].nunique() == len(found) - found.duplicated("sequence_id").sum()
    assert (found[found["length"] == 64].groupby("sequence_id").size() == 1).all()


def naive_peaks(samples):
    raw, out = [x - 128 for x in samples], []
    frames = -(-len(raw) // media.HOP)
    window = np.hanning(media.FRAME).astype(np.float32)
    for t in range(frames):
        part = raw[t * media.HOP : t * media.HOP + media.FRAME]
        part = np.array(part + [0] * (media.FRAME - len(part)), np.float32)
        part = (part - part.mean()) * window
        k = np.arange(media.FRAME // 2 + 1)[:, None]
        size = np.abs((part[None, :] * np.exp(-2j * np.pi * k * np.arange(media.FRAME)[None, :] / media.FRAME)).sum(axis=1))
        for low, high in media.BANDS:
            out.append((t, size[low:high]))
    return out


def test_fingerprints_are_those_of_a_naive_transform():
    samples = media.payload("A plain text of some words, with Ünïcode and 12345 digits. " * 12)
    times, bins = media.peaks(samples)
    of_frame = defaultdict(list)
    for t, b in zip(times.tolist(), bins.tolist(), strict=True):
        of_frame[t].append(b)
    for i, (t, size) in enumerate(naive_peaks(samples)):
        low, high = media.BANDS[i % len(media.BANDS)]
        found = [b for b in of_frame[t] if low <= b < high]
        assert len(found) == (size.max() > 1e-3) and (not found or size[found[0] - low] >= size.max() - 1e-2)
    pairs = sorted((t, (a << 16) | (b << 8) | (u - t)) for t in of_frame for u in of_frame if 1 <= u - t <= media.FAN for a in of_frame[t] for b in of_frame[u])
    at, codes = media.fingerprint(samples)
    assert sorted(zip(at.tolist(), codes.tolist(), strict=True)) == pairs


def test_media_query_stores_files_and_fingerprints(spark, tmp_path):
    frame(spark, [(1, "some text " * 40), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    for r in media.op9_media(spark, str(tmp_path)).collect():
        samples, _ = media.read_wav(bytes(r["media"]))
        at, codes = media.fingerprint(samples)
        assert hashlib.sha256(bytes(r["media"])).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"]
        assert r["fingerprint_times"] == at.tolist() and r["fingerprint_codes"] == codes.tolist()


@pytest.mark.parametrize(("k", "percent", "seed"), [(1, 60, 1), (1, 80, 2), (2, 70, 3)])
def test_links_of_small_sets(spark, k, percent, seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(rng.sample(words[:8] if i % 2 else words, rng.randrange(1, 8)))) for i in range(400)]
    found = jaccard.near_duplicates(frame(spark, rows).repartition(4), k, percent)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows, k, percent)


@pytest.mark.parametrize("block", [40, 200])
def test_large_groups_lose_no_link(spark, block):
    """A cluster far over a block, with sets that link to a few of its members only, and a chain."""
    rng = random.Random(8)
    base = [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(base[:-1] + [f"x{i}"])) for i in range(60)]
    rows += [(100 + i, " ".join([*base[:-3], f"x{rng.randrange(60)}", "y", f"z{i % 5}"])) for i in range(30)]
    rows += [(200 + i, " ".join(f"c{j}" for j in range(i, i + 30))) for i in range(40)]
    found = jaccard.near_duplicates(frame(spark, rows).repartition(3), 1, 90, block)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows, 1, 90)


def test_rare_shingles_cut_what_common_passages_chain(spark):
    """Documents of four common passages and some words of their own are chained; only copies of them link."""
    rng = random.Random(11)
    passages = [" ".join(f"p{i}x{j}" for j in range(60)) for i in range(12)]
    rows = [(i, " ".join([*rng.sample(passages, 4), *(f"u{i}x{j}" for j in range(75))])) for i in range(120)]
    rows += [(200 + i, f"{rows[i][1]} more") for i in range(10)]
    docs = frame(spark, rows).repartition(3)
    sets = jaccard.set_table(docs, 5)
    nodes = sets.groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("short").alias("short"))
    assert jaccard._grouped(docs, nodes, 5, 80, 2000).count() == 20
    found = jaccard.near_duplicates(docs, 5, 80, 2000)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows, 5, 80)


def test_chunks_searched_in_batches_lose_no_link(spark, monkeypatch):
    """Sets of a large group go to many tasks; a batch of tasks is sent a share of the corpus, not every pair of chunks."""
    rng = random.Random(12)
    rows = [(i, " ".join([*(f"v{j}" for j in range(30)), *(f"x{i // 3}y{j}" for j in range(10 + i % 3))])) for i in range(90)]
    rows += [(100 + i, " ".join([*(f"v{j}" for j in range(29)), f"z{rng.randrange(20)}"])) for i in range(40)]
    monkeypatch.setattr(jaccard, "SENT_LEAST", 500)
    sent, cut = [], jaccard.common.cut
    monkeypatch.setattr(jaccard.common, "cut", lambda df, name, **how: (sent.append(name), cut(df, name, **how))[1])
    found = jaccard.near_duplicates(frame(spark, rows).repartition(3), 1, 90, 200)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_components(rows, 1, 90)
    assert sent.count("found") > 2 and "members" in sent


def test_keep_first_keeps_columns_of_any_name(spark):
    rows = frame(spark, [(5, "a b c d e f g"), (3, "a b c d e f g")]).withColumns({c: F.lit("x") for c in ("gone", "__gone", "key", "doc", "node")})
    kept = jaccard.keep_first(rows)
    assert kept.columns == rows.columns and [r["doc_id"] for r in kept.collect()] == [3]
    assert jaccard.keep_first(rows.limit(0)).count() == 0


def brute_passages(rows, length):
    """(doc_id, row, first) -> words of repeated runs, each row a document."""
    places = defaultdict(list)
    for row, (doc, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        for s in range(len(w) - length + 1):
            places[tuple(w[s : s + length])].append(((doc is not None, doc or 0), row, s))
    found = defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for doc, row, s in at:
                found[row, (doc, row, s) == min(at)] |= set(range(s, s + length))
    return found


@pytest.mark.parametrize("hot", [3, 5000])
def test_rows_of_one_doc_id_repeat_each_other(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(hot)
    passage = [f"p{i}" for i in range(80)]
    rows = [(7, " ".join(passage)), (7, " ".join(passage)), (None, " ".join(passage)), (None, "x " + " ".join(passage)), (9, None), (10, "w " * 300)]
    rows += [(100 + i, " ".join([f"u{rng.randrange(10**6)}" for _ in range(20)] + passage[i % 3 : 70 + i % 5])) for i in range(25)]
    found = suffixes.repeats(frame(spark, rows, extra=True).coalesce(1)).collect()
    got, expected = defaultdict(int), defaultdict(int)
    for r in found:
        got[r["doc_id"], r["first"]] += r["n_words"]
    for (row, first), words in brute_passages(rows, 50).items():
        expected[rows[row][0], first] += len(words)
    assert dict(got) == dict(expected)
    assert got[7, False] == 160


def brute_terms(rows):
    """Places of disclosing words, from document counts by plain loops."""
    import math

    import regex

    n, of_entity, of_term, words = max(len(rows), 2), defaultdict(set), defaultdict(set), {}
    for row, (_, text) in enumerate(rows):
        for kind, s, e in brute_spans(text):
            of_entity[kind, text[s:e].lower()].add(row)
        words[row] = [(m.start() - 1, m.end() - 1, m.group().lower()) for m in regex.finditer(pii.TERM, f" {text or ''} ")]
        for _, _, w in words[row]:
            of_term[w].add(row)
    told = defaultdict(float)
    for docs in of_entity.values():
        content = math.log(n / len(docs))
        if content <= 0:
            continue
        for w in {w for row in docs for _, _, w in words[row]}:
            expected = pii.PRIOR * math.exp(-content)
            told[w] = max(told[w], 1 + math.log((len(docs & of_term[w]) + expected) / (len(of_term[w]) + pii.PRIOR)) / content)
    return {row: [(s, e, told[w] >= pii.REMOVE) for s, e, w in words[row] if told[w] >= pii.GENERALISE] for row in range(len(rows))}


def test_terms_are_those_of_plain_counts(spark):
    rng = random.Random(13)
    names = [f"{a}{b}" for a in ("Zan", "Quil", "Mor", "Tyl") for b in ("zibar", "lonby", "venna", "ero")]
    rows = []
    for i in range(250):
        w = rng.choices(["many", "common", "words", "İstanbul", "über", "report"], k=rng.randrange(12)) + rng.choices(names, k=rng.choice((0, 0, 1, 2)))
        w += rng.choice(([], [], [], ["a@b.example"], [f"u{rng.randrange(9)}@c.example", "10.0.0.1"], ["+1 212 555 0100"]))
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " ".join(f"p{i}@list.example onlyhere" for i in range(300)))]
    found = {r["doc_id"]: [(s["start"], s["end"], s["remove"]) for s in r["terms"]] for r in pii.find(pii.numbered(frame(spark, rows, extra=True))).collect()}
    expected = brute_terms(rows)
    assert {k for k, v in found.items() if v} and found == {rows[row][0]: v for row, v in expected.items()}


def test_spans_of_long_texts_are_found_in_time(spark):
    import time

    began = time.time()
    rows = [(1, "a@b.cc " * 40_000), (2, "1.2.3.4 +1 212 555 0100, " * 20_000)]
    found = {r["doc_id"]: (len(r["email"]), len(r["ip"]), len(r["phone"])) for r in pii.find(pii.numbered(frame(spark, rows))).collect()}
    assert found == {1: (40_000, 0, 0), 2: (0, 20_000, 20_000)} and time.time() - began < 60


def test_query_tells_removed_from_generalised_terms(spark, tmp_path):
    filler = "many common words and nothing else to report, write and call"
    rows = [(1, f"Quillonby {filler} to help@desk.example"), *((10 + i, f"Zanzibarov {filler} to boss@corp.example") for i in range(20)), *((100 + i, filler) for i in range(400))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["spans"] for r in pii.op8_pii(spark, str(tmp_path)).collect()}
    assert found[1].endswith(",term:0:9") and found[10].endswith(",removed:0:10") and found[100] == ""
