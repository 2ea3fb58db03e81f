"""Changes touch the partitions they name, numbering and budgets run when asked, sums stay in their period."""

from __future__ import annotations

import datetime as dt
import os
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from remitloom.operators import budget, commission, keyed, masters, rating, review
from remitloom.sources import store
from remitloom.sources.bindings import bind

SF = "/root/testdata/sf0.001"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture
def stored(spark, tmp_path):
    """A master of 2,000 keys stored by the partition of its key."""
    table = spark.range(2000).selectExpr("concat('K', id) as code", "id % 7 as v")
    path = f"{tmp_path}/master"
    store.save(keyed.with_part(table, ["code"], 32), path, "part")
    return path


def check(spark, path, changes, whole):
    """Applying the changes gives what the whole-table form gives, and leaves the files of other partitions alone."""
    touched = {r.part for r in changes.rows.select("part").union(changes.emptied.select("part")).distinct().collect()}
    before = files(path)
    want = rows(whole)
    store.apply(changes.rows, changes.emptied, path, "part")
    after = files(path)
    of = lambda name: int(re.search(r"part=(\d+)", name).group(1))
    assert {f: t for f, t in before.items() if of(f) not in touched} == {f: t for f, t in after.items() if of(f) not in touched}
    assert 0 < len(touched) < 32
    assert rows(spark.read.parquet(path).drop("part")) == want


def test_upsert_touches_its_partitions(spark, stored):
    table, batch = spark.read.parquet(stored), spark.createDataFrame([("K5", 100), ("K77", 101), ("NEW", 102)], "code string, v long")
    changes = keyed.changes_of_upsert(table, batch, ["code"], {"v": "v"}, 32)
    assert re.search(r"PartitionFilters: \[[^\]]*array_contains\(", plan(changes.rows))
    check(spark, stored, changes, keyed.keyed_upsert(table.drop("part"), batch, ["code"], {"v": "v"}))


def test_update_and_delete_touch_their_partitions(spark, stored):
    table, batch = spark.read.parquet(stored), spark.createDataFrame([("K9",), ("K1500",), ("nobody",)], "code string")
    check(spark, stored, keyed.changes_of_update(table, batch, ["code"], {"v": F.lit(55).cast("long")}, 32),
          keyed.keyed_update(table.drop("part"), batch, ["code"], {"v": F.lit(55).cast("long")}))
    table = spark.read.parquet(stored)
    check(spark, stored, keyed.changes_of_delete(table, batch, ["code"], 32), keyed.delete_where(table.drop("part"), batch=batch, keys=["code"]))


def test_a_partition_left_empty_is_removed(spark, stored):
    table = spark.read.parquet(stored)
    gone = table.where("part = 3").select("code")
    changes = keyed.changes_of_delete(table, gone, ["code"], 32)
    assert [r.part for r in changes.emptied.collect()] == [3] and changes.rows.isEmpty()
    check(spark, stored, changes, keyed.delete_where(table.drop("part"), batch=gone, keys=["code"]))
    assert not os.path.exists(f"{stored}/part=3")


def test_an_empty_batch_changes_nothing(spark, stored):
    changes = keyed.changes_of_delete(spark.read.parquet(stored), spark.createDataFrame([], "code string"), ["code"], 32)
    before = files(stored)
    store.apply(changes.rows, changes.emptied, stored, "part")
    assert files(stored) == before


def test_status_change_by_run(spark):
    t = bind(spark, SF)
    details = t.rac_rbdetailstrans
    batch = details.where("genid in (11, 12)").select("genid", "u_paycode", "whscode").distinct()
    changed = review.changes_of_status(details, batch, review.approve_payees).rows
    assert re.search(r"PartitionFilters: \[[^\]]*array_contains\(", plan(changed))
    whole = review.approve_payees(details, batch).where("genid in (11, 12)")
    assert rows(changed) == rows(whole.select(*changed.columns)) and changed.count() > 0


def test_reset_by_run(spark):
    """Run 1 is paid and stays; of runs 2 and 3 the ledger keeps marks outside their dates only."""
    day = dt.date
    runs = spark.createDataFrame([(1, day(2001, 1, 1), day(2001, 1, 31), day(2001, 2, 5)), (2, day(2001, 2, 1), day(2001, 2, 28), None), (3, day(2001, 3, 1), day(2001, 3, 31), None)],
                                 "genid int, fdate date, tdate date, paymentdate date")
    oinv = spark.createDataFrame([(1, day(2001, 1, 3)), (2, day(2001, 2, 3)), (3, day(2001, 3, 3)), (4, day(2000, 1, 1))], "docentry int, recondate date")
    ledger = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (2, 2, 2), (4, 1, 2), (3, 1, 3), (2, 3, 9)], "docentry int, linenum int, genid int")
    batch = spark.createDataFrame([(1,), (2,), (3,), (3,), (7,)], "genid int")
    changes = review.changes_of_reset(runs, ledger, oinv, batch)
    assert rows(changes.dropped) == [(2,), (3,)] and rows(changes.ledger.rows) == [(4, 2, 1)] and rows(changes.ledger.emptied) == [(3,)]
    whole = ledger
    for run in (2, 3):
        whole = review.generation_reset(runs, ledger, whole, oinv, run).ledger
    assert rows(whole) == rows(ledger.where("genid not in (2, 3)").unionByName(changes.ledger.rows))


class Jobs:
    """Jobs the session starts inside the block."""

    def __init__(self, spark):
        self.context = spark.sparkContext

    def __enter__(self):
        self.context.setJobGroup("counted", "counted")
        return self

    def __exit__(self, *_):
        self.n = len(self.context.statusTracker().getJobIdsForGroup("counted"))
        self.context.setJobGroup("", "")


@pytest.mark.parametrize("schema,values", [
    ("k string", [("b",), ("a",), ("a",), (None,), ("zz",), ("Ä",), ("aaaaaaab",), ("aaaaaaaa",)]),
    ("k date", [(dt.date(1950, 1, 2),), (dt.date(2100, 3, 4),), (None,), (dt.date(1950, 1, 1),), (dt.date(1950, 1, 1),)]),
    ("k long", [(-(1 << 62),), (1 << 62,), (5,), (5,), (4,), (None,)]), ("k decimal(18,2)", [(Decimal(1),), (Decimal(-3),), (None,)]), ("k timestamp", [(dt.datetime(2001, 1, 1),)]), ("k int", [])])
def test_numbers_follow_the_order(spark, schema, values):
    df = spark.createDataFrame([(*v, n) for n, v in enumerate(values)], schema + ", x int").repartition(3)
    with Jobs(spark) as jobs:
        numbered = keyed.number_rows(df, ["k"], "n")
        numbered._jdf.queryExecution().executedPlan()
    assert jobs.n == 0
    for window in re.findall(r"Window \[.*?\], \[.*?\]", plan(numbered)):
        assert "_stretch" in window
    got = sorted(numbered.collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(1, len(values) + 1))
    assert [(r.k, r.x) for r in got] == [(r.k, r.x) for r in df.orderBy("k", "x").collect()]


def test_numbering_starts_no_job(spark):
    t = bind(spark, SF)
    t.soadate, t.odrs
    with Jobs(spark) as jobs:
        review.generation_register(t.soadate, t.soadate.limit(0).withColumn("genid", F.lit(0)))
        masters.retag_log(t.odrs.selectExpr("dcode as cardcode", "dname"), 7)
        keyed.append_with_identity(t.soadate, t.soadate.drop("genid"), "genid", ["fdate"])
    assert jobs.n == 0


def test_budgets_of_all_runs_are_those_of_each(spark):
    t = bind(spark, SF)
    args = (t.jdt1, t.ojdt, t.oact, t.rbdets, t.rb_payees, t.rac_budgetcriteria, t.soadate)
    every = budget.branch_budgets(*args)
    for run in (5, 40, 79):
        one = budget.branch_budget_create(*args, run, 0)
        assert rows(every.lines.where(F.col("genid") == run)) == rows(one.lines)
        assert rows(every.header.where(F.col("genid") == run)) == rows(one.header)
    later = budget.branch_budgets(*args, first_run=30)
    assert rows(later.lines.where("genid = 40")) == rows(budget.branch_budget_create(*args, 40, 30).lines)


def test_a_threshold_met_late_and_lost_again(frame):
    """A sum below the threshold passes nothing; once above it all of it passes; with a debit it falls back."""
    details = frame([(g, "P", "W", Decimal(r), "X", 0, 0, dt.date(2001, 1, 1)) for g, r in ((1, 60), (2, 50), (4, -40), (5, 1))] + [(3, "Q", "W", Decimal(10), "X", 0, 0, dt.date(2001, 1, 1))],
                    "genid int, u_paycode string, whscode string, rebate decimal(18,2), comtype string, isforpaymnt int, isexcluded int, recondate date")
    payees = frame([("P", "ACCOUNT", "1"), ("Q", "ACCOUNT", "1")], "pid string, actype string, slpcode string")
    criteria = frame([("W", "ACCOUNT", Decimal(100))], "whscode string, accounttype string, amntexcluded decimal(18,2)")
    got = budget.prefix_gate(details, payees, criteria).orderBy("genid").collect()
    assert [(r.genid, int(r.passed), int(r.open)) for r in got] == [(1, 0, 60), (2, 110, 50), (3, 0, 10), (4, -110, -40), (5, 0, 1)]


@pytest.fixture
def nothing_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def test_a_period_sums_its_own_credits_and_payments(spark, nothing_broadcast):
    t = bind(spark, SF)
    for name in ("rin1", "aopdet2", "inv1", "oinv"):
        t[name]
    fact = commission.invoice_line_fact(t.oinv, t.inv1, t.rin1, t.aopdet2, "1996-03-01", "1996-03-31")
    tree = fact._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join LeftSemi, \(u_labno", tree)) == 1 and len(re.findall(r"Join LeftSemi, \(docentry", tree)) == 2
    whole = commission.invoice_line_fact(t.oinv, t.inv1, t.rin1, t.aopdet2).where("docdate between '1996-03-01' and '1996-03-31'")
    assert rows(fact) == rows(whole) and fact.count() > 0


def test_a_run_sums_its_own_loose_credits(spark, nothing_broadcast):
    t = bind(spark, SF)
    rated = rating.rated_lines(t, "1996-03-01", "1996-03-31", gen_id=15)
    assert re.search(r"Join LeftSemi, \(u_labno", rated._jdf.queryExecution().optimizedPlan().toString())
    whole = rating.rated_lines(t, runs=t.soadate).where("recondate between '1996-03-01' and '1996-03-31'")
    columns = ["docentry", "linenum", "cm", "ip", "rate", "amt", "comtype"]
    assert rows(rated.select(*columns)) == rows(whole.select(*columns)) and rated.count() > 0
