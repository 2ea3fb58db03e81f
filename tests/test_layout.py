"""Products by blocks, intervals by month, stored layouts and what they save."""

from __future__ import annotations

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from remitloom.operators import aging, commission, masters, rating
from remitloom.operators.product import product
from remitloom.sources import store
from remitloom.sources.bindings import bind, by_document
from remitloom.sources.tables import Tables

from .test_changes import plan, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def nothing_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_product_of_blocks(spark, block):
    left = spark.range(30).selectExpr("id", "if(id % 5 = 0, null, id % 3) as x")
    right = spark.range(40).selectExpr("id % 25 as k", "concat('n', id % 25) as name")
    got = rows(product(left, right, block))
    want = rows(left.crossJoin(right.distinct()))
    assert got == want and len(got) == 750
    assert rows(product(left, right.limit(0), block)) == [] and rows(product(left.limit(0), right, block)) == []


def test_grids_collect_blocks_only(spark, nothing_broadcast):
    t = bind(spark, SF)
    for df in (commission.sales_target_grid(t.oslp, t.calendar, t.comtargetdtl), masters.share_expand_branches(t.odrs, t.sapset, t.oacs1).shares):
        text = plan(df)
        assert "collect_set" not in text and "collect_list" in text
        assert re.search(r"hashpartitioning\((cast\()?_l#", text) and not re.search(r"NestedLoop|Cartesian", text)


def test_an_account_with_ten_thousand_intervals(spark, nothing_broadcast):
    """A third of the lines is of one account with 10,000 tag intervals: same rows, dealt out by month."""
    rng, start = random.Random(5), dt.date(1999, 1, 1)
    day = lambda n: start + dt.timedelta(n)
    tags = [(100, "HOT", "h", str(n % 40), day(n // 4), day(n // 4 + n % 3)) for n in range(10_000)]
    tags += [(100, f"C{n}", "c", "7", day(0), dt.date(2099, 12, 31)) for n in range(50)] + [(102, "HOT", "d", "9", day(10), day(400)), (100, "C1", "c", "8", day(50), day(40))]
    lines = [(n, 100 if n % 7 else 102, "HOT" if n % 3 == 0 else f"C{n % 60}", "HOT" if n % 2 else "D1", day(rng.randrange(3000)) if n % 11 else None) for n in range(3000)]
    lines = spark.createDataFrame(lines + [(-1, 103, "C1", "D1", day(3))], "docentry long, groupcode int, cardcode string, u_doctorcode string, docdate date")
    tags = spark.createDataFrame(tags, "stype int, bpcode string, bpname string, slpcode string, sdate date, edate date")
    code = F.when(F.col("groupcode") == 100, F.col("cardcode")).otherwise(F.col("u_doctorcode"))
    plain = lines.where("groupcode in (100, 102)").join(
        tags, (F.col("stype") == F.col("groupcode")) & (F.col("bpcode") == code) & F.col("docdate").between(F.col("sdate"), F.col("edate")), "left").drop("stype", "sdate", "edate")
    found = commission.asof_rep_assignment(lines, tags)
    assert rows(found) == rows(plain)
    assert re.search(r"hashpartitioning\(_key#\d+, \d+", plan(found)) and "SortMergeJoin [_key" in plan(found)
    assert rows(commission.asof_rep_assignment(lines, tags, dense=0)) == rows(plain)
    # no month of the hot account holds more than a few dozen intervals, and its lines lie in many months
    months = commission.tag_months(tags, tags.select("stype", "bpcode").distinct().withColumn("_dense", F.lit(True))).where("bpcode = 'HOT' and stype = 100")
    assert months.groupBy("_bin").count().agg(F.max("count")).first()[0] < 150 and months.select("_bin").distinct().count() > 80


def test_an_open_interval_by_month_costs_the_months_of_its_lines(spark, nothing_broadcast):
    """Every code by month: an interval is repeated for the months its code has lines in, not for all it spans; rows and columns stay."""
    start = dt.date(2001, 1, 15)
    lines = [(n, 100 if n % 3 else 102, None if n % 17 == 0 else f"C{n % 9}", f"D{n % 4}", start + dt.timedelta(31 * (n % 5)) if n % 13 else None) for n in range(120)]
    lines = spark.createDataFrame(lines + lines[:9] + [(-1, None, "C1", "D1", start)], "docentry long, groupcode int, cardcode string, u_doctorcode string, docdate date")
    tags = [(100, f"C{n}", "c", str(n), dt.date(1990, 1, 1), dt.date(2099, 12, 31)) for n in (1, 1, 2, 3, 50)] + [
        (102, "D1", "d", "7", start, start + dt.timedelta(40)), (102, "D1", "d", "8", dt.date(2001, 2, 28), start), (102, "D2", "d", "9", None, start),
        (100, None, "e", "5", start, dt.date(2099, 12, 31)), (None, "C1", "f", "6", start, dt.date(2099, 12, 31))]
    tags = spark.createDataFrame(tags, "stype int, bpcode string, bpname string, slpcode string, sdate date, edate date")
    found, plain = commission.asof_rep_assignment(lines, tags, dense=0), commission.asof_rep_assignment(lines, tags)
    assert found.columns == plain.columns and rows(found) == rows(plain)
    assert found.where("bpcode is not null").count() == 45 and found.where("docdate is null").count() == 11
    assert "Generate" not in plan(found) and "SortMergeJoin [_key" in plan(found)


def test_bucketed_facts_are_not_moved(spark, nothing_broadcast):
    """Joins by document of tables that lie by document need no exchange of the lines."""
    t = by_document(bind(spark, SF))
    lines = t.inv1.join(t.oinv.select("docentry", "docdate"), "docentry").join(
        t.aopdet2.groupBy("docentry").agg(F.sum("linetotal").alias("paid")), "docentry", "left")
    text = plan(lines)
    assert "Exchange" not in text and "Bucketed: true" in text
    moved = lambda tables: len(re.findall(r"hashpartitioning\(docentry", plan(rating.installment_paid(
        tables.inv1.join(tables.oinv.select("docentry"), "docentry"), tables.aopdet2, tables.jdt1, tables.oact, tables.rct2, tables.orct))))
    assert moved(t) < moved(bind(spark, SF))


def test_tables_of_the_catalog(spark, frame, tmp_path):
    store.save_bucketed(frame([(n, n % 3) for n in range(20)], "docentry long, v long"), "default.layout_fact", ["docentry"], 4, path=f"{tmp_path}/fact")
    try:
        fact = Tables.catalog(spark).layout_fact
        assert fact.count() == 20 and "Exchange" not in plan(fact.groupBy("docentry").count())
    finally:
        spark.sql("drop table default.layout_fact")


def test_stored_tables_leave_no_shuffle_on_disk(spark):
    """What staging and freezing have shuffled goes with the write, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = lambda: set(re.findall(r"shuffle_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",")))
    sums = lambda n: spark.range(200).selectExpr("id % 20 as docentry").groupBy("docentry").agg(F.count(F.lit(n)).alias("v"))
    before, setting = blocks(), spark.conf.get(key, None)
    stored = [store.freeze(sums(1)), store.staged(spark, "layout", "sums", lambda: sums(2)), store.staged(spark, "layout", "sums_by_v", lambda: sums(3), "v"),
              store.staged_bucketed(spark, "layout", "sums_bucketed", lambda: sums(4), ["docentry"], 2)]
    for _ in range(100):
        if not blocks() - before:
            break
        time.sleep(0.1)
    assert not blocks() - before and spark.conf.get(key, None) == setting
    for table in stored:
        assert rows(table) == sorted([(n, 10) for n in range(20)], key=str)
    result = sums(5)
    assert rows(result) == rows(result) == rows(stored[0])


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.append_batch(spark.range(5).selectExpr("id", "id % 2 as genid"), path, "run-7", "genid")
    store.append_batch(spark.range(100, 103).selectExpr("id", "5 as genid"), path, "run-8", "genid")
    # the repeated job has other partitions than the one that failed
    store.append_batch(spark.range(4).selectExpr("id", "0 as genid"), path, "run-7", "genid")
    assert rows(spark.read.parquet(path).select("id", "genid")) == sorted([(0, n) for n in range(4)] + [(5, n) for n in range(100, 103)], key=str)
    with pytest.raises(ValueError):
        store.append_batch(spark.range(1), path, "../x")


def test_a_run_reads_its_months_of_the_ledger(spark, tmp_path):
    t = bind(spark, SF)
    path = f"{tmp_path}/ledger"
    store.save(rating.monthly_marks(t.rac_rbdetailstrans), path, "month")
    ledger = spark.read.parquet(path)
    lines = rating.rebate_eligible_lines(t.oinv, t.inv1, t.ocrd_ext, t.ocrd, t.rac_rebprclvlmntnce, "1996-01-15", "1996-02-10", ledger, gen_id=13)
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ >= 1996-01-01[^\]]*month#\d+ <= 1996-02-01", plan(lines))
    whole = rating.rebate_eligible_lines(t.oinv, t.inv1, t.ocrd_ext, t.ocrd, t.rac_rebprclvlmntnce, "1996-01-15", "1996-02-10", ledger.drop("month"), gen_id=13)
    assert rows(lines) == rows(whole)
    marks = rating.monthly_marks(t.rac_rbdetailstrans.where("genid = 13"), ledger.where("docentry % 2 = 0"))
    assert re.search(r"PartitionFilters: \[[^\]]*array_contains\(", plan(marks))
    assert marks.count() > 0 and marks.where("docentry % 2 = 0").isEmpty()


def test_ageing_from_stored_sums_reads_no_payment(spark, tmp_path):
    t = bind(spark, SF)
    sums = aging.DaySums(t.aging_unpaid, t.aging_settled, t.aging_current)
    found = aging.aging_by_payee_of(sums, t.soadate, t.rb_payees, "2001-07-15")
    text = plan(found)
    assert not re.search(r"o_orderkey|o_totalprice|recid|docid", text) and "aging_unpaid" in text
    for as_of in ("2001-07-15", "2000-01-01"):
        assert rows(aging.aging_by_payee_of(sums, t.soadate, t.rb_payees, as_of)) == rows(
            aging.aging_by_payee(t.rac_rbpayments, t.rac_rbaginghistory, t.soadate, t.rb_payees, as_of))
    # a run is added by writing its partition
    path = f"{tmp_path}/unpaid"
    store.save(aging.unpaid_sums(t.rac_rbpayments.where("genid < 70")), path, "genid")
    for run in range(70, 81):
        store.replace_partitions(aging.unpaid_sums(t.rac_rbpayments.where(F.col("genid") == run)), path, "genid")
    assert rows(spark.read.parquet(path)) == rows(t.aging_unpaid)
