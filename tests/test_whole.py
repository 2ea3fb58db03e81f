"""Nothing is cut: wide sums, long counts, complete lists, any case, keys named once, and run-limited reading."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from remitloom.operators import aging, budget, cheques, commission, keyed, masters, rating, review
from remitloom.sources import store
from remitloom.sources.bindings import bind

SF = "/root/testdata/sf0.001"


def test_budget_of_five_billion(frame):
    lines = frame([(1, "001", D("5000000000.00"), D("2.00"), D("100000000.00"), D("7.00"))],
                  "genid int, whscode string, sales decimal(18,2), percnt decimal(18,2), budgetamt decimal(18,2), rebates decimal(18,2)")
    heads = frame([(1, dt.date(2020, 1, 1), dt.date(2020, 1, 31))], "genid int, startdate date, enddate date")
    row = budget.budget_summary(heads, lines).first()
    assert (row.totalsales, row.totalexcess) == (D("5000000000.00"), D("99999993.00"))
    batch = frame([(1, "001", D("3.00"))], "genid int, whscode string, percnt decimal(18,2)")
    assert budget.budget_repercent(lines, batch).first().budgetamt == D("150000000.00")


def test_counts_of_six_digits(spark, frame):
    rows = spark.range(200_000).selectExpr(
        "id as recid", "'P' as pid", "cast(id as string) as cheqnum", "date'2024-01-02' as cheqdate", "0 as iscrosscheq", "date'2024-01-02' as trandate",
        "if(id < 123456, 4, 3) as stat", "'A' as acctno", "1 as genid", "cast(1 as decimal(18,2)) as payment")
    payees = frame([("P", "n", "a", "7", 1)], "pid string, pname string, add1 string, slpcode string, isactive int").withColumns(
        {c: F.lit(None).cast("string") for c in ("class", "acctnum", "hosp", "telno", "actype", "periodtype", "dispatchtype", "iscrosscheck", "isspecialtest")})
    reps = frame([("7", "rep")], "slpcode string, slpname string")
    assert cheques.cheque_progress_by_rep(rows, payees, reps).first().total == "123456 / 200000"


def test_lists_are_complete_and_ignore_case(spark, frame):
    accounts = spark.range(2000).selectExpr("concat('C', id) as cardcode", "concat('Red Pill ', id) as cardname", "'C' as cardtype", "100 as groupcode")
    assert masters.customer_search(accounts, text="rED p").count() == 2000 and masters.customer_search(accounts, text="red", shown=5).count() == 5
    items = accounts.selectExpr("cardcode as itemcode", "cardname as itemname", "'N' as invntitem")
    packs = frame([], "imh_code string, imh_type string, imh_desc string")
    assert masters.item_search(items, packs, text="PILL").count() == 2000
    doctors = accounts.selectExpr("cardcode as dcode", "cardname as dname", "'1' as slpcode", *[f"'' as {c}" for c in (
        "hosp", "u_location", "add1", "sched", "specialization", "acctno", "phone1", "email", "remarks")])
    assert masters.clinician_list(doctors, frame([("1", "x")], "slpcode string, slpname string"), name="red PILL").count() == 2000


def test_keys_named_twice(frame):
    target = frame([("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="names a key twice"):
        keyed.insert_if_absent(target, frame([("b", 2), ("b", 2)], "k string, v int"), ["k"]).collect()
    assert keyed.insert_if_absent(target, frame([("a", 5), ("b", 2)], "k string, v int"), ["k"]).count() == 2
    tags = frame([(102, "D1", "n", "7", dt.date(2019, 1, 1), dt.date(2019, 1, 1), dt.date(2099, 12, 31))],
                 "stype int, bpcode string, bpname string, slpcode string, encodedate date, sdate date, edate date")
    people = frame([("D1", "7")], "dcode string, slpcode string")
    batch = frame([("D1", "n", "8", dt.date(2020, 3, 1))] * 2, "dcode string, dname string, slpcode string, taggeddate date")
    with pytest.raises(Exception, match="names a key twice"):
        masters.rep_retag_scd2(tags, people, people.withColumnRenamed("dcode", "pid"), batch, "2020-05-20").tags.collect()


def test_log_of_a_retag(frame):
    tags = frame([(102, "D1", "n", "7", dt.date(2019, 1, 1), dt.date(2019, 1, 1), dt.date(2099, 12, 31))],
                 "stype int, bpcode string, bpname string, slpcode string, encodedate date, sdate date, edate date")
    people = frame([("D1", "7")], "dcode string, slpcode string")
    batch = frame([("D1", "n", "8", dt.date(2020, 3, 1))], "dcode string, dname string, slpcode string, taggeddate date")
    changes = masters.rep_retag_scd2(tags, people, people.withColumnRenamed("dcode", "pid"), batch, "2020-05-20").changes
    row = masters.retag_log(changes, last_log=41).first()
    assert (row.docentry, row.from_rep, row.to_rep, row.remarks, row.recom, row.effdate) == (42, "7", "8", "8", "", dt.date(2020, 5, 20))


def test_loose_inhouse_update_takes_several_items_of_an_account(frame):
    schema = "itemcode string, itemname string, whscode string, grpcode string, itemtype string, cardcode string, rate decimal(18,2), amt decimal(18,2)"
    row = lambda item, rate: (item, "n", "001", "100", "S", "C1", D(rate), D("0"))
    out = masters.update_special_inhouse(frame([row("I1", "1"), row("I2", "1")], schema), frame([row("I1", "9"), row("I2", "8")], schema), strict=False)
    assert [r.rate for r in out.collect()] == [D("8.00"), D("8.00")]


def test_posting_dates_its_runs(frame):
    runs = frame([(1, None), (2, None)], "genid int, paymentdate date")
    dated = review.date_runs(runs, frame([(2,), (2,)], "genid int"), "2020-03-04")
    assert {r.genid: r.paymentdate for r in dated.collect()} == {1: None, 2: dt.date(2020, 3, 4)}


def test_a_change_touches_only_its_runs(spark, tmp_path):
    path = str(tmp_path / "details")
    rows = spark.range(40).selectExpr("id", "cast(id % 4 as int) as genid", "'P' as u_paycode", "0 as stat")
    store.save(rows, path, partition_by="genid")
    files = lambda g: {p.name for p in (tmp_path / "details" / f"genid={g}").glob("part-*")}
    before = {g: files(g) for g in range(4)}
    details = spark.read.parquet(path)
    batch = spark.createDataFrame([(2, "P")], "genid int, u_paycode string")
    changed = review.rebate_status_update(review.of_runs(details, batch), batch, ["genid", "u_paycode"], {"stat": F.lit(1)})
    store.replace_partitions(changed.select(*details.columns), path, "genid")
    assert {g for g in range(4) if files(g) != before[g]} == {2}
    assert {(r.genid, r.stat) for r in spark.read.parquet(path).collect()} == {(0, 0), (1, 0), (2, 1), (3, 0)}
    assert store.drop_partition(spark, path, "genid", 1) and not store.drop_partition(spark, path, "genid", 9)
    assert spark.read.parquet(path).count() == 30 and files(0) == before[0]


def test_marks_to_append(frame):
    details = frame([(1, 1, 9), (1, 1, 9), (1, 2, 9), (2, 1, 9)], "docentry long, linenum int, genid int")
    ledger = frame([(1, 1, 3)], "docentry long, linenum int, genid int")
    assert sorted(map(tuple, rating.new_marks(details, ledger).collect())) == [(1, 2, 9), (2, 1, 9)]
    assert rating.incremental_line_marking(details, ledger).count() == 3


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def formatted(spark, df) -> str:
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_a_run_reads_its_own_receipts_credits_and_ledger(spark, no_broadcast):
    t = bind(spark, SF)
    ledger = t.rac_rbdetailstrans.select("docentry", "linenum")
    plan = formatted(spark, rating.rated_lines(t, frm="1996-01-01", to="1996-01-31", gen_id=13, ledger=ledger))
    assert len(re.findall(r"LeftSemi", plan)) >= 6  # receipts, installments, credits and ledger, besides the two receipt filters
    anti = plan.index("LeftAnti", 0)
    assert "recondate" in plan[anti:]  # the date filter stands below the comparison with the ledger


def test_all_invoice_lines_move_twice(spark, no_broadcast):
    t = bind(spark, SF)
    plan = spark._jvm.PythonSQLUtils.explainString(commission.invoice_line_fact(t.oinv, t.inv1, t.rin1, t.aopdet2)._jdf.queryExecution(), "formatted")
    moves = [c for c in re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\n", plan) if "u_doctorcode#" in c]
    assert len(moves) == 2, moves


def test_open_items_sort_has_no_hot_key(spark, frame):
    rows = aging.aging_open_items(
        frame([(i, 1, "001", "P", D("1"), 2) for i in range(50)], "recid long, genid int, whscode string, pcode string, unpaidrebates decimal(18,2), status int"),
        frame([(1, None)], "genid int, paymentdate date"))
    assert "recid" in re.search(r"rangepartitioning\((.*)", formatted(spark, rows)).group(1)
