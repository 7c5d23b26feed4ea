"""Edge cases and invariants of the operators on inline rows."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lakemill.functions import cleaning as C
from lakemill.operators import ranking, scd2, script
from lakemill.operators.constraints import split, violations
from lakemill.operators.report import period_comparison, previous_period
from lakemill.operators.tables import CommitConflict, ConstraintViolation, Transaction, VersionedTable
from lakemill.sources import files
from lakemill.streaming import ingest as stream


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_cleaning_is_total_in_ansi_mode(spark):
    rows = spark.createDataFrame([("$12.50",), ("Rs.9.75",), ("-1",), ("unknown",), ("",), (None,)], "x string")
    assert [r[0] for r in rows.select(C.first_number(F.col("x"))).collect()] == [12.5, 9.75, -1.0, None, None, None]
    dates = spark.createDataFrame([("2024-01-02 03:04:05",), ("05-01-2024",), ("2026-13-40",), (None,)], "x string")
    assert [str(r[0])[:10] for r in dates.select(C.parse_timestamp(F.col("x"))).collect()] == ["2024-01-02", "2024-01-05", "None", "None"]


def test_title_case_starts_words_after_any_other_sign(spark):
    rows = spark.createDataFrame([("  usb-c   t-shirt ",), ("children's USB Cable",)], "x string")
    assert [r[0] for r in rows.select(C.title_case(F.col("x"))).collect()] == ["Usb-C T-Shirt", "Children'S Usb Cable"]


def test_orphans_discounts_zero_quantities_and_future_dates(spark):
    orders = spark.createDataFrame([(1,), (2,), (3,)], "order_id long")
    items = spark.createDataFrame([(1, 1, 150, 2), (2, 999, 50, 0)], "item_id long, order_id long, discount int, quantity int")
    assert values(items.join(orders, "order_id", "left_anti"), "item_id") == [(2,)]
    clipped = items.select("item_id", C.clip(F.col("discount"), 0, 100).alias("d"), "quantity")
    assert values(clipped.select("item_id", (F.col("quantity") * 10 * (100 - F.col("d")) / 100).alias("r")), "item_id", "r") == [(1, 0.0), (2, 0.0)]
    later = spark.createDataFrame([(date(2030, 1, 1),)], "d date")
    assert later.where(F.col("d") > F.lit("2024-01-01").cast("date")).count() == 1


def test_split_is_exact(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    good, bad = split(rows, F.col("v") > 0)
    assert values(good, "k") == [(1,)] and values(bad, "k") == [(2,), (3,)]


def test_violations_name_the_constraint(spark):
    parents = spark.createDataFrame([(1,)], "id int")
    rows = spark.createDataFrame([(1, "a@x", 5.0, 1), (2, "a@x", 6.0, 1), (3, "b@x", -50.0, 1), (4, "c@x", 1.0, 999), (5, None, None, None), (6, None, 1.0, 1)], "k int, email string, price double, parent int")
    found = violations(rows, {"price_positive": F.col("price") > 0}, {"email_unique": ["email"]}, ["k"], {"parent_fk": ("parent", parents, "id")})
    assert values(found, "k", "violated") == [(1, None), (2, "email_unique"), (3, "price_positive"), (4, "parent_fk"), (5, None), (6, None)]


def test_rebuild_agrees_with_the_daily_loop(spark):
    rng = random.Random(3)
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(4)]
    seed = [(k, rng.choice("ab"), date(2023, 1, 1)) for k in range(6)]
    changes = [(rng.randrange(8), rng.choice("ab"), d, i) for i, d in enumerate(sorted(rng.choices(days, k=40)))]
    seeds = spark.createDataFrame(seed, "id long, v string, day date")
    feed = spark.createDataFrame(changes, "id long, v string, day date, seq long")
    built = scd2.rebuild(feed, "id", ["v"], "day", ["seq"], seeds)
    looped = scd2.rebuild(feed.limit(0), "id", ["v"], "day", ["seq"], seeds)
    for d in days:
        looped = scd2.apply_day(looped, feed.where(F.col("day") == F.lit(d)), "id", ["v"], "day", ["seq"])
    columns = built.columns
    assert values(built, *columns) == values(looped, *columns)
    assert built.where("is_current").groupBy("id").count().where("count <> 1").isEmpty()
    facts = spark.createDataFrame([(i, i % 9, days[i % 4]) for i in range(20)], "f long, id long, on_day date")
    assert scd2.as_of(facts, built, "id", "on_day", ["v"]).count() == 20


def test_versions_history_and_time_travel(spark, tmp_path):
    clock = iter(range(10))
    table = VersionedTable(spark, str(tmp_path / "t"), clock=lambda: next(clock))
    table.commit(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    table.merge(spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string"), ["k"])
    table.commit(spark.createDataFrame([(4, "D", 1.5)], "k int, v string, w double"), mode="append", evolve=True)
    assert values(table.read(0), "k", "v") == [(1, "a"), (2, "b")]
    assert values(table.read_as_of(1), "k", "v") == [(1, "a"), (2, "B"), (3, "C")]
    assert values(table.read(), "k", "w") == [(1, None), (2, None), (3, None), (4, 1.5)]
    assert values(table.history(), "version", "operation", "rows") == [(0, "OVERWRITE", 2), (1, "MERGE", 3), (2, "APPEND", 4)]
    with pytest.raises(ValueError, match="twice"):
        table.merge(spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string"), ["k"])
    with pytest.raises(ValueError, match="columns differ"):
        table.commit(spark.createDataFrame([(9,)], "other int"), mode="append")
    path, text = table.stage(table.read().limit(1))
    table.commit(table.read().limit(2))
    with pytest.raises(CommitConflict):
        table.files.publish(path, text)


def test_transactions_are_seen_whole_or_not_at_all(spark, tmp_path):
    a, b = VersionedTable(spark, str(tmp_path / "a")), VersionedTable(spark, str(tmp_path / "b"))
    for t in (a, b):
        t.commit(spark.range(3))
    with pytest.raises(RuntimeError), Transaction(spark, str(tmp_path)) as txn:
        txn.commit(a, spark.range(9))
        raise RuntimeError
    assert a.read().count() == 3
    with Transaction(spark, str(tmp_path)) as txn:
        txn.commit(a, spark.range(5))
        txn.commit(b, spark.range(1), mode="append")
    assert (a.read().count(), b.read().count()) == (5, 4)


def test_streaming_adds_each_file_once_and_follows_drift(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.range(5).coalesce(1).write.parquet(source)
    for expected in (5, 5):
        stream.ingest(spark, source, spark.range(1).schema, target, checkpoint)
        assert spark.read.parquet(target).count() == expected
    spark.range(2).coalesce(1).write.mode("append").parquet(source)
    stream.ingest(spark, source, spark.range(1).schema, target, checkpoint)
    assert spark.read.parquet(target).count() == 7
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.csv").write_text("a,b\n1,x\n")
    (feed / "2.csv").write_text("c,a\nnew,2\n")
    stream.ingest_drifting_csv(spark, str(feed), str(tmp_path / "drift"), str(tmp_path / "drift_checkpoint"), ["a", "b", "c"])
    assert values(spark.read.parquet(str(tmp_path / "drift")), "a", "b", "c") == [("1", "x", None), ("2", None, "new")]


def test_drifting_files_and_audit_columns(spark, tmp_path):
    (tmp_path / "1.csv").write_text("k,v\n1,a\n")
    (tmp_path / "2.csv").write_text("coupon,k,v\nC,2,b\n")
    rows = files.read_drifting_csv(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")])
    assert values(rows, "k", "v", "coupon") == [("1", "a", None), ("2", "b", "C")]
    audited = files.with_audit(files.read_csv(spark, str(tmp_path / "1.csv")), "batch", "2024-01-01 00:00:00")
    assert audited.first()["load_type"] == "batch" and audited.first()["source_file"].endswith("1.csv")


def test_previous_period_has_as_many_days():
    assert previous_period(date(2024, 3, 1), date(2024, 3, 31)) == (date(2024, 1, 30), date(2024, 2, 29))


def test_script_runs_whole_statements_and_counts_their_rows(spark):
    spark.range(0, 1000, 1, 4).createOrReplaceTempView("script_ids")
    text = """-- 1. all
SELECT id, id AS id FROM script_ids ORDER BY 1;
-- 2. late
SELECT 1 / (id - 990) AS x FROM script_ids;
-- 3. none
SELECT * FROM script_ids WHERE false;
-- 4. view
CREATE OR REPLACE TEMP VIEW script_few AS SELECT * FROM script_ids WHERE id < 3;
-- 5. few
SELECT * FROM script_few;
"""
    found = script.run(spark, text)
    assert [(title, len(rows), total) for title, rows, total, _ in found] == [("all", 10, 1000), ("late", 0, 0), ("none", 0, 0), ("view", 0, 0), ("few", 3, 3)]
    assert [x[0] for x in found[0][1]] == list(range(10)) and [title for title, *_, error in found if error] == ["late"]


def test_lost_updates_are_refused(spark, tmp_path):
    one, other = VersionedTable(spark, str(tmp_path / "t")), VersionedTable(spark, str(tmp_path / "t"))
    one.commit(spark.createDataFrame([(1, "a")], "k int, v string"))
    changed = one.updated(F.lit(True), {"v": F.lit("z")})
    other.commit(spark.createDataFrame([(2, "b")], "k int, v string"), mode="append")
    with pytest.raises(CommitConflict):
        one.commit(changed, operation="UPDATE")
    assert values(other.read(), "k", "v") == [(1, "a"), (2, "b")]
    one.update(F.col("k") == 2, {"v": F.lit("z")})
    assert values(other.read(), "k", "v") == [(1, "a"), (2, "z")]


def test_an_append_follows_whatever_came_first(spark, tmp_path):
    one, other = VersionedTable(spark, str(tmp_path / "t")), VersionedTable(spark, str(tmp_path / "t"))
    one.commit(spark.range(1))
    stage = one.stage

    def late(*args, **how):
        staged = stage(*args, **how)
        other.commit(spark.range(2), mode="append")
        return staged

    one.stage = late
    assert one.commit(spark.range(3), mode="append") == 2
    assert one.read().count() == 6 and one.latest()["rows"] == 6


def test_a_pending_transaction_is_given_up_for_an_append(spark, tmp_path):
    a, b = VersionedTable(spark, str(tmp_path / "a")), VersionedTable(spark, str(tmp_path / "b"))
    for t in (a, b):
        t.commit(spark.range(3))
    txn = Transaction(spark, str(tmp_path))
    txn.commit(a, spark.range(10), mode="append")
    txn.commit(b, spark.range(10), mode="append")
    for table, path, text in txn.staged:  # between its entries and its manifest
        table.files.publish(path, text)
    VersionedTable(spark, str(tmp_path / "a")).commit(spark.range(1), mode="append")
    with pytest.raises(CommitConflict):
        txn.files.publish(txn.manifest, '{"state": "committed"}')
    assert (a.read().count(), b.read().count()) == (4, 3)


def test_constraints_of_a_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.create("k int, v string, n int", not_null=["v"], defaults={"n": "7"}, checks={"n_small": "n < 10"}, unique={"k_once": ["k"]})
    table.insert(spark.createDataFrame([(1, "a")], "k int, v string"))
    with pytest.raises(ConstraintViolation) as broken:
        table.insert(spark.createDataFrame([(1, "b", 1), (2, None, 1), (3, "c", 11), (4, "d", 1), (4, "e", 1)], "k int, v string, n int"))
    assert broken.value.broken == {"k_once": 2, "not_null_v": 1, "n_small": 1}
    assert values(table.read(), "k", "v", "n") == [(1, "a", 7)]


@pytest.mark.parametrize("most", [7, 1000])
def test_ranks_and_sums_in_ranges_are_those_of_one_task(spark, most):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0, 0, 1, 2, rng.randrange(50)])) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(3)
    found = ranking.ordered(df, "v", ["k"], {"s": "v"}, most).withColumns({"tile": ranking.tile(4), "many": ranking.tile(100)})
    df.createOrReplaceTempView("ranked")
    order = "ORDER BY v DESC NULLS LAST, k"
    told = spark.sql(f"SELECT k, row_number() OVER ({order}) AS place, rank() OVER (ORDER BY v DESC NULLS LAST) AS rank, sum(v) OVER ({order} ROWS UNBOUNDED PRECEDING) AS running_s, sum(v) OVER () AS total_s, ntile(4) OVER ({order}) AS tile, ntile(100) OVER ({order}) AS many FROM ranked")
    assert values(found, *told.columns) == values(told, *told.columns)


def test_a_feed_stops_at_new_columns_and_goes_on(spark, tmp_path):
    feed, table, log = tmp_path / "feed", VersionedTable(spark, str(tmp_path / "t")), stream.SchemaLog(spark, str(tmp_path / "log"))
    feed.mkdir()
    (feed / "1.csv").write_text("a,b\n1,x\n")
    run = lambda: stream.ingest_feed(spark, str(feed), table, str(tmp_path / "c"), log, "2024-01-01 00:00:00")
    run()
    (feed / "2.csv").write_text('"b, too",a\nnew,2\n')
    with pytest.raises(stream.SchemaChanged):
        run()
    assert table.read().count() == 1
    run()
    run()
    assert values(table.read(), "a", "b", "b, too") == [("1", "x", None), ("2", None, "new")]
    with pytest.raises(Exception, match="not declared"):
        stream.ingest_drifting_csv(spark, str(feed), str(tmp_path / "d"), str(tmp_path / "dc"), ["a", "b"])


def test_timestamps_of_events_have_days_first_and_those_of_orders_are_guessed(spark):
    rows = spark.createDataFrame([("05/01/2024",), ("25/12/2024",), ("2024-01-02",), ("2024-01-02T03:04:05",), ("31/02/2024",), (None,)], "x string")
    assert [r[0] and str(r[0])[:10] for r in rows.select(C.parse_timestamp(F.col("x"), C.EVENT_FORMATS)).collect()] == ["2024-01-05", "2024-12-25", "2024-01-02", "2024-01-02", None, None]
    rows = spark.createDataFrame([("05-01-2024",), ("2024-01-02",), ("05/01/2024",), ("2026-13-40",), ("",)], "x string")
    assert [r[0] and str(r[0])[:10] for r in rows.select(C.guess_timestamp(F.col("x"))).collect()] == ["2024-01-05", "2024-01-02", "2024-05-01", None, None]


def test_a_period_ends_with_its_last_day_and_never_before_it_starts(spark):
    orders = spark.createDataFrame([(1, 1, 10.0, "2024-03-31 15:00:00"), (2, 1, 5.0, "2024-04-01 00:00:00"), (3, 2, 4.0, "2024-02-29 23:59:59")], "o_orderkey long, o_custkey long, o_totalprice double, at string")
    orders = orders.withColumn("o_orderdate", F.col("at").cast("timestamp"))
    found = period_comparison(orders, "2024-03-01", "2024-03-31").first()
    assert (found["orders"], found["revenue"], found["orders_before"], found["revenue_before"], found["change"]) == (1, 10.0, 1, 4.0, 150.0)
    with pytest.raises(ValueError, match="before it starts"):
        period_comparison(orders, "2024-03-31", "2024-03-01")
    with pytest.raises(ValueError):
        period_comparison(orders, "31-03-2024", "2024-04-01")


def test_strict_versions_leave_out_what_is_before_them(spark):
    versions = spark.createDataFrame([("s1", 1, "a", date(2024, 1, 5), date(9999, 12, 31))], "id_sk string, id int, v string, effective_start_date date, effective_end_date date")
    facts = spark.createDataFrame([(1, 1, date(2024, 1, 4)), (2, 1, date(2024, 1, 5)), (3, 2, date(2024, 1, 1))], "f int, id int, on_day date")
    assert values(scd2.as_of_strict(facts, versions, "id", "on_day", ["v"]), "f", "v") == [(2, "a"), (3, None)]
