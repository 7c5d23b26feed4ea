"""Personal data: pattern spans, and terms that the corpus shows to reveal them, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm import common

#: Quantifiers are possessive and starts are anchored where that changes no match: no text makes them backtrack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a text must match to have a valid span of a kind.
MAY = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9][\x20().0-9-]{7}"}
#: Documents that the prior weighs when the share of a term's documents that have an entity is estimated.
PRIOR = 1.0
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.95

TERM = r"(?<=[^\p{L}0-9@._%+-])\p{L}{3,}+(?=\P{L})(?![._%+-]*+[0-9A-Za-z@])"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    """True if the digits, each second one from the right doubled, add up to a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _parts(text: Column, pattern: str) -> Column:
    """Every match of a text with its number and the length before it; a last entry has no match."""
    return F.transform(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("hit"))),
        lambda x, i: F.struct(i.alias("at"), x["gap"].alias("gap"), x["hit"].alias("hit")),
    )


def _located(parts: DataFrame, *by: str) -> DataFrame:
    """``parts`` (..., at, gap, hit) with ``start`` and ``end`` in code points; ``by`` tells texts and patterns apart.

    Lengths are summed up over the matches before, in a window over one text's matches of one pattern.
    """
    size = F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))
    end = F.sum(size).over(W.partitionBy(*by).orderBy("at").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return parts.withColumn("end", end).where("hit IS NOT NULL").withColumn("start", F.col("end") - F.length("hit")).drop("at", "gap")


def _padded(text: str) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _terms(text: str) -> Column:
    """The distinct words of a whole text.

    Words that are joined to digits or to signs of an address are left out, so none overlaps a span.
    """
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(_padded(text), F.lit(TERM), F.lit(0))), _term))


def base_spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, hit) of the valid matches in (row, text), as a table in the shared folder.

    Only texts that may have a valid match of a kind are searched for it.
    """

    def matches(kind: str) -> Column:
        named = F.transform(_parts(F.col("text"), PATTERNS[kind]), lambda x: F.struct(F.lit(kind).alias("kind"), x["at"].alias("at"), x["gap"].alias("gap"), x["hit"].alias("hit")))
        return F.when(F.col("text").rlike(MAY[kind]), named)

    found = list(map(matches, KINDS))
    parts = rows.select("row", F.explode(F.array_compact(F.array(*found))).alias("x")).select("row", F.explode("x").alias("x")).select("row", "x.*")
    hits = _located(parts, "row", "kind")
    ok = F.lit(False)
    for k in KINDS:
        ok = F.when(F.col("kind") == k, valid(k, F.col("hit"))).otherwise(ok)
    return common.cut(hits.where(ok).select("row", "kind", "start", "end", "hit"), "spans")


def classes(base: DataFrame, n: float) -> DataFrame:
    """(row, entity, n_entity, content): entities, each a value of a kind, with all rows of texts that have them.

    Entities that stand in the very same texts disclose by the very same terms, so one of them stands for all: a list
    of addresses that are nowhere else is one. Those of every text tell nothing and are left out.
    """
    rows = base.select("row", F.xxhash64("kind", F.lower("hit")).alias("entity")).distinct()
    same = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    sizes = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), *same)
    sizes = sizes.groupBy("n_entity", "h0", "h1").agg(F.min("entity").alias("entity"))
    sizes = sizes.select("entity", "n_entity", F.log(F.lit(n) / F.col("n_entity")).alias("content")).where("content > 0")
    return common.hot_join(rows, common.cut(sizes, "entities"), ["entity"], "n_entity", "row")


def disclosing(rows: DataFrame, base: DataFrame, counts: DataFrame, prior: float = PRIOR, threshold: float = GENERALISE) -> DataFrame:
    """(entity, term, n_term, disclosure) from the document counts of the whole corpus.

    Disclosure is the pointwise mutual information of term and entity over the entity's information content: near 1
    if the term is never without the entity, 0 if it says nothing about it. The entity's share of the term's
    documents is smoothed by ``prior`` documents that have the entity as often as the corpus does, so a rare entity
    counts too, and one document tells less than many. Terms in too many documents to reach
    ``threshold``, even if each document of the entity had them, are left out before terms and entities are paired.
    """
    expected = prior * F.exp(-F.col("content"))
    most = ((F.col("n_entity") + expected) * F.exp(F.col("content") * (1 - threshold)) - prior) * (1 + 1e-9)
    within = common.cut(classes(base, float(max(rows.count(), 2))).withColumn("most", most), "within")
    bounds = within.groupBy("row").agg(F.max("most").alias("bound"))
    words = rows.join(bounds, "row").select("row", "bound", F.explode(_terms("text")).alias("term"))
    words = common.hot_join(words, counts, ["term"], "n_term", "row").where("n_term <= bound").select("row", "term", "n_term")
    both = words.join(within, "row").where("n_term <= most")
    pairs = both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair"), F.first("n_term").alias("n_term"), F.first("content").alias("content"))
    ratio = 1 + F.log((F.col("n_pair") + expected) / (F.col("n_term") + prior)) / F.col("content")
    return pairs.select("entity", "term", "n_term", ratio.alias("disclosure")).where(F.col("disclosure") >= threshold)


def term_spans(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(row, kind, start, end, hit) of every place in (row, text) of the terms of (term, n_term, remove).

    Words that are no such term are kept out of the shuffle by a set of fixed size.
    """
    words = rows.select("row", F.explode(_terms("text")).alias("term"))
    words = common.maybe_in(words, F.col("term"), common.bit_table(told.select("term")), "told").where("told").drop("told")
    flagged = common.hot_join(words, told, ["term"], "n_term", "row")
    flagged = common.cut(flagged.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "remove"))).alias("flagged")), "flagged")
    common.release(rows.sparkSession)
    some = common.maybe_in(rows, F.xxhash64("row"), common.bit_table(flagged.select(F.xxhash64("row"))), "some").where("some").drop("some")
    parts = some.join(flagged, "row").select("row", "flagged", F.explode(_parts(_padded("text"), TERM)).alias("x"))
    parts = parts.select("row", F.try_element_at("flagged", _term(F.col("x.hit"))).alias("remove"), "x.*")
    kind = F.when(F.col("remove"), F.lit("removed")).otherwise(F.lit("term"))
    return _located(parts, "row").where("remove IS NOT NULL").select("row", kind.alias("kind"), (F.col("start") - 1).alias("start"), (F.col("end") - 1).alias("end"), "hit")


def spans(rows: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(row, kind, start, end, hit) of all spans in (row, text), as a table in the shared folder.

    Kinds are those of the patterns, and for words that disclose an entity, at all places in all texts, "term" where
    it is to be generalised or "removed" where even the general class is too much.
    """
    base = base_spans(rows)
    words = rows.select(F.explode(_terms("text")).alias("term"))
    counts = common.cut(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "counts")
    common.release(rows.sparkSession)
    told = disclosing(rows, base, counts, prior).groupBy("term").agg(F.max("n_term").alias("n_term"), (F.max("disclosure") >= REMOVE).alias("remove"))
    told = common.cut(told, "disclosing")
    common.release(rows.sparkSession)
    return common.cut(base.unionAll(term_spans(rows, told)), "found")


@common.tidy
def find(rows: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(row, doc_id, email, ip, card, phone, terms) for every row of (row, doc_id, text), read more than once.

    The first four are pattern spans. ``terms`` are all places, in all texts, of words that disclose an
    entity, as co-occurrence in the whole corpus tells; they have a flag ``remove`` where even the general class is too much.

    Defined results: a null text is empty and has no span; overlapping spans of different kinds all count; repeated
    rows each count as a document; an empty table gives no rows; other columns are ignored.
    """
    one = F.struct("start", "end", "hit", F.col("kind").alias("kind"), (F.col("kind") == "removed").alias("remove"))
    found = spans(rows, prior).groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    of = lambda *kinds: F.filter(F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)), lambda s: s["kind"].isin(*kinds))
    return rows.select("row", "doc_id").join(found, "row", "left").select("row", "doc_id", *(of(k).alias(k) for k in KINDS), of("term", "removed").alias("terms"))


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


@common.tidy
def sanitise(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``docs`` with the text of every span replaced by its kind, [TERM] or, for removed terms, nothing.

    Of overlapping spans the first gives the replacement for all that they cover. Texts without a span are
    not shuffled.

    Defined results: a null text stays null and has no span; repeated rows each count as a document and stay; an
    empty table gives no rows; other columns stay as they are, whatever their names.
    """
    kept = common.cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "texts", compression="zstd")
    found = spans(kept.select("row", F.coalesce("doc.text", F.lit("")).alias("text")), prior)
    by = F.when(F.col("kind") == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    order = W.partitionBy("row").orderBy("start", "end", "by")
    found = found.select("row", "start", "end", by.alias("by"))
    opens = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = found.groupBy("row", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("opens") == 1, F.col("by"))).alias("by"))
    found = common.cut(found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "by"))).alias("spans")), "marked")
    told = common.maybe_in(kept, F.xxhash64("row"), common.bit_table(found.select(F.xxhash64("row"))), "some")
    text = F.col("doc.text")
    before = lambda i: F.when(i > 0, F.element_at("spans", i)["end"]).otherwise(F.lit(0))
    pieces = F.transform("spans", lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), s["by"]))
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at("spans", -1)["end"] + 1, F.lit(2147483647)))
    clean = F.when(F.col("spans").isNull(), text).otherwise(clean)
    changed = told.where("some").join(found, "row", "left").select(*(clean.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))
    return told.where("NOT some").select("doc.*").unionAll(changed)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.cut(numbered(common.table(spark, sf_dir, "documents")), "texts", compression="zstd"))
    text = lambda k, c: F.transform(c, lambda s: F.concat_ws(":", F.lit(k) if k else s["kind"], s["start"], s["end"]))
    base = F.concat(*(text(k, k) for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, text(None, "terms")), ",").alias("spans"),
    )
