"""Hand-made cases for commissions, review, aging, cheques, masters and change batches."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from remitloom.functions.buckets import AGE_LABELS, aging_bucket_pivot
from remitloom.functions.money import percent_of, ratio_percent
from remitloom.functions.text import normalise_keys
from remitloom.operators import aging, budget, cheques, commission, keyed, masters, review

DAY = dt.date


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- commissions ------------------------------------------------------------------

def test_credit_counts_against_every_line_of_the_case(frame):
    oinv = frame([(1, "L1", "C1", DAY(2020, 1, 5), "001", "1")],
                 "docentry long, labno string, cardcode string, docdate date, whscode string, pmode string")
    inv1 = frame([(1, n, "I1", "L1", "", "D1", "1", "001", D(a)) for n, a in ((1, "10"), (2, "4"), (3, "7"))] +
                 [(1, 4, "I1", "L1", "", "D1", "2", "001", D("99"))],
                 "docentry long, linenum int, itemcode string, u_labno string, u_packageno string, u_doctorcode string, "
                 "u_paymenttyp string, whscode string, linetotal decimal(18,2)")
    rin1 = frame([("L1", "001", "I1", D("4"))], "u_labno string, whscode string, itemcode string, linetotal decimal(18,2)")
    paid = frame([(1, 1, D("2")), (1, 1, D("3"))], "docentry long, linenum int, linetotal decimal(18,2)")
    fact = commission.invoice_line_fact(oinv, inv1, rin1, paid, "2020-01-01", "2020-01-31")
    # line 2 nets to zero and drops out; pay type 2 earns nothing
    assert rows(fact, "linenum", "amount", "adjamt", "paid") == [(1, 10, 4, 5), (3, 7, 4, 0)]
    assert commission.invoice_line_fact(oinv, inv1, rin1, paid, "2020-02-01", "2020-02-28").count() == 0


def test_rep_by_interval_and_incidental_zero(frame):
    lines = frame([(1, DAY(2020, 6, 30), 100, "C1", "D1", "Mission", "REGULAR", D("5"), D("1")),
                   (2, DAY(2020, 7, 1), 102, "C1", "D1", "INCIDENTAL", "REGULAR", D("5"), D("1")),
                   (3, DAY(2020, 7, 1), 102, "C1", "D1", "INCIDENTAL", "SP", D("5"), D("1")),
                   (4, DAY(2020, 7, 1), 104, "C1", "D1", "", "SP", D("5"), D("1"))],
                  "docentry int, docdate date, groupcode int, cardcode string, u_doctorcode string, hospital string, "
                  "ti_test_grp string, linetotal decimal(18,2), paid decimal(18,2)")
    tags = frame([(100, "C1", "x", "7", DAY(2020, 1, 1), DAY(2020, 6, 30)), (100, "C1", "x", "8", DAY(2020, 7, 1), DAY(2099, 12, 31)),
                  (102, "D1", "y", "9", DAY(2020, 1, 1), DAY(2099, 12, 31)), (102, "D1", "y", "3", DAY(2020, 7, 1), DAY(2020, 7, 1))],
                 "stype int, bpcode string, bpname string, slpcode string, sdate date, edate date")
    got = commission.incidental_zeroing(commission.asof_rep_assignment(lines, tags))
    # overlapping intervals repeat the line
    assert rows(got, "docentry", "slpcode", "linetotal", "lineamnt") == [
        (1, "7", 5, 5), (2, "3", 0, 5), (2, "9", 0, 5), (3, "3", 5, 5), (3, "9", 5, 5)]


def test_payout_rounds_half_up(frame):
    heads = frame([(1, "7", D("40.25"), D("30.25"))],
                  "genid int, slpcode string, salesnetpercentage decimal(18,2), callsnetpercentage decimal(18,2)")
    lines = frame([(1, "7", D("100.01")), (1, "7", None), (1, "8", D("5"))], "genid int, slpcode string, commission decimal(18,2)")
    out = commission.commission_payout(heads, lines)
    assert rows(out.headers, "commgross", "commnet") == [(D("100.01"), D("70.51"))]   # 70.507…
    assert out.lines.count() == 2
    half = heads.select(percent_of(F.lit(D("0.50")), F.lit(D("1"))).alias("x"), percent_of(F.lit(D("-0.50")), F.lit(1)).alias("y"),
                        ratio_percent(F.lit(1), F.lit(0)).alias("z"))
    assert tuple(half.first()) == (D("0.01"), D("-0.01"), None)


# --- review and runs ----------------------------------------------------------------

def test_repeated_payee_rows_multiply_only_without_dedupe(frame):
    rebates = frame([(1, 1, "P", "001", "7", D("10"), D("2"), 1), (0, 1, "P", "002", "7", D("50"), D("0"), 1)],
                    "status int, genid int, u_paycode string, whscode string, slpcode string, actualreb decimal(18,2), "
                    "agingreb decimal(18,2), isforpayment int")
    payees = frame([("P", 1), ("P", 1)], "pid string, iscrosscheck int")
    assert rows(review.cheque_post_run(rebates, payees, "2020-01-01").headers, "payment") == [(12,)]
    assert rows(review.cheque_post_run(rebates, payees, "2020-01-01", dedupe=False).headers, "payment") == [(24,)]


def test_reset_and_register(spark, frame):
    runs = frame([(1, DAY(2020, 1, 1), DAY(2020, 1, 31), DAY(2020, 2, 1)), (2, DAY(2020, 2, 1), DAY(2020, 2, 29), None)],
                 "genid int, fdate date, tdate date, paymentdate date")
    details = frame([(1, 10), (2, 20)], "genid int, docentry long")
    ledger = frame([(10, 1, 1), (20, 1, 2), (21, 1, 1)], "docentry long, linenum int, genid int")
    oinv = frame([(10, DAY(2020, 1, 5)), (20, DAY(2020, 2, 5)), (21, DAY(2020, 2, 6))], "docentry long, recondate date")
    paid = review.generation_reset(runs, details, ledger, oinv, 1)
    assert (paid.runs.count(), paid.details.count(), paid.ledger.count()) == (2, 2, 3)
    open_ = review.generation_reset(runs, details, ledger, oinv, 2)
    assert rows(open_.runs, "genid") == [(1,)] and rows(open_.details, "genid") == [(1,)]
    assert rows(open_.ledger, "docentry") == [(10,), (21,)]
    forced = review.generation_reset(runs, details, ledger, oinv, 2, force=True, frm="2020-02-01", to="2020-02-29")
    assert rows(forced.ledger, "docentry") == [(10,)]       # also the line another run had marked
    new = frame([(0, DAY(2020, 3, 1), DAY(2020, 3, 31)), (0, DAY(2020, 4, 1), DAY(2020, 4, 30)), (9, DAY(2020, 5, 1), DAY(2020, 5, 31))],
                "genid int, fdate date, tdate date")
    assert rows(review.generation_register(runs, new), "genid") == [(1,), (2,), (9,), (10,), (11,)]


# --- aging ----------------------------------------------------------------------------

def test_pivot_keeps_the_sum_of_due_amounts(frame):
    data = frame([("a", d, D(d + 10)) for d in (-5, 0, 30, 31, 60, 61, 90, 91, 120, 121, 400)] + [("b", -1, D("3"))],
                 "k string, days int, v decimal(18,2)")
    wide = aging_bucket_pivot(data, "days", "v", ["k"]).collect()
    assert len(wide) == 1                                    # amounts not due yet have no class
    assert [wide[0][c] for c in AGE_LABELS] == [50, 111, 171, 231, 541]


def test_settled_amount_is_taken_from_every_day_group(frame):
    runs = frame([(1, DAY(2020, 1, 1)), (2, DAY(2020, 2, 1)), (3, None)], "genid int, paymentdate date")
    pay = frame([(1, 1, "001", "P", D("100"), D("9"), 2), (2, 2, "001", "P", D("50"), D("9"), 2), (3, 3, "001", "P", D("1"), D("9"), 1)],
                "recid long, genid int, whscode string, pcode string, unpaidrebates decimal(18,2), actualrebates decimal(18,2), status int")
    hist = frame([(3, "001", "P", D("10"), DAY(2020, 1, 1), DAY(2020, 1, 3))],
                 "genid int, whscode string, pcode string, amountpaid decimal(18,2), paymentdate date, createddate date")
    branch = frame([("001", "B")], "code string, whsname string")
    plan = frame([(3, "001", D("7"))], "genid int, whscode string, budgetamnt decimal(18,2)")
    got = aging.aging_by_branch(pay, hist, runs, branch, plan, "2020-02-20")
    assert rows(got, "d01_30", "d31_60", "totamnttopay", "currrebs", "budgetamnt") == [(0, 90, 10, 9, 7), (40, 0, 10, 9, 7)]
    one = aging.aging_by_branch(pay, hist, runs, branch, plan, "2020-02-20", collapse_days=True)
    assert rows(one, "d01_30", "d31_60", "totalaging") == [(40, 90, 130)]
    batch = frame([(1, 1, "001", "P", D("100"), D("100"), DAY(2020, 1, 1)), (2, 2, "001", "P", D("50"), D("20"), DAY(2020, 2, 1))],
                  "docid long, genid int, whscode string, pcode string, unpaidrebates decimal(18,2), amountpaid decimal(18,2), paymentdate date")
    assert rows(aging.aging_apply_payment(pay, hist, batch, "u", "2020-03-01").payments, "recid", "status") == [(1, 1), (2, 2), (3, 1)]


def test_document_gate_is_inverted(frame):
    details = frame([(1, "P", "L", "C", "001", "D", 102, D("5"), "X", 0, 0, 4, DAY(2020, 1, 1))],
                    "docentry long, u_paycode string, u_labno string, cardcode string, whscode string, u_doctorcode string, groupcode int, "
                    "rebate decimal(18,2), comtype string, isexcluded int, isforpaymnt int, genid int, recondate date")
    payees = frame([("P", "T", "7")], "pid string, actype string, slpcode string")
    none = frame([], "accounttype string, whscode string, amntexcluded decimal(18,2)")
    assert rows(budget.payment_detail_lines(details, payees, none, "2020-01-31", 3), "budgetstat", "ndys") == [(0, 30)]
    assert rows(budget.payee_branch_gate(details, payees, none, "T", "P", 1, 4), "budgetstat") == [(1,)]


# --- cheques ----------------------------------------------------------------------------

def test_number_search_without_pattern_finds_nothing(frame):
    book = frame([(1, "a", "b", "OA", "011", "Rebates", "AC1")],
                 "id int, minchk string, maxchk string, acctype string, whscode string, chktype string, acctno string")
    numbers = frame([(1, "1007", None, 0, None), (1, "1008", None, 1, None)], "id int, chknum string, opnum string, stat int, remarks string")
    assert cheques.chequebook_available(book, numbers, search=True).count() == 0
    assert rows(cheques.chequebook_available(book, numbers, pattern="07", search=True), "chknum") == [("1007",)]
    assert cheques.chequebook_available(book, numbers, account="AC1").count() == 1


def test_void_frees_cancelled_numbers_only(frame):
    head = frame([(1, "P", D("5"), "100", DAY(2020, 1, 1), 1, "7", 4, "AC1", 9), (2, "Q", D("6"), "101", None, 1, "7", 4, "AC1", 9)],
                 "recid long, pid string, payment decimal(18,2), cheqnum string, cheqdate date, iscrosscheq int, slpcode string, stat int, "
                 "acctno string, genid int")
    book = frame([(1, "AC1")], "id int, acctno string")
    numbers = frame([(1, "100", None, 1, None), (1, "101", None, 1, None)], "id int, chknum string, opnum string, stat int, remarks string")
    batch = frame([(9, "100", "AC1", "1", "wrong", "u"), (9, "101", "AC1", "2", "old", "u")],
                  "genid int, cheqnum string, acctno string, voidtype string, remarks string, voidedby string")
    out = cheques.cheque_void(head, book, numbers, batch, "2020-02-01")
    assert sorted(map(str, rows(out.cheques, "recid", "cheqnum", "acctno", "stat"))) == ["(1, None, None, 3)", "(2, None, None, 3)"]
    assert rows(out.numbers, "chknum", "stat", "remarks") == [("100", 0, "wrong"), ("101", 1, "old")]
    assert rows(out.voids, "tranid", "cheqnum", "voidtype") == [(1, "100", "1"), (2, "101", "2")]


# --- masters ------------------------------------------------------------------------------

@pytest.mark.parametrize("tagged, start, closed", [
    (DAY(2020, 3, 15), DAY(2020, 3, 1), DAY(2020, 2, 29)), (DAY(2020, 3, 16), DAY(2020, 6, 1), DAY(2020, 3, 31))])
def test_retag_by_day_of_month(frame, tagged, start, closed):
    tags = frame([(102, "D1", "n", "7", DAY(2019, 1, 1), DAY(2019, 1, 1), DAY(2099, 12, 31)),
                  (102, "D2", "n", "7", DAY(2019, 1, 1), DAY(2019, 1, 1), DAY(2099, 12, 31))],
                 "stype int, bpcode string, bpname string, slpcode string, encodedate date, sdate date, edate date")
    docs, payees = frame([("D1", "7"), ("D2", "7")], "dcode string, slpcode string"), frame([("D1", "7")], "pid string, slpcode string")
    batch = frame([("D1", "n", "8", tagged), ("D2", "n", "7", tagged)], "dcode string, dname string, slpcode string, taggeddate date")
    out = masters.rep_retag_scd2(tags, docs, payees, batch, "2020-05-20")
    assert rows(out.tags.where("bpcode = 'D1'"), "slpcode", "sdate", "edate") == [
        ("7", DAY(2019, 1, 1), closed), ("8", start, DAY(2099, 12, 31))]
    assert out.tags.where("bpcode = 'D2'").count() == 1 and out.changes.count() == 1
    assert rows(out.clinicians, "dcode", "slpcode") == [("D1", "8"), ("D2", "7")] and rows(out.payees, "slpcode") == [("8",)]


def test_inhouse_update_strict_or_by_account(frame):
    schema = "itemcode string, itemname string, whscode string, grpcode string, itemtype string, cardcode string, rate decimal(18,2), amt decimal(18,2)"
    spcl = frame([("I1", "n", "001", "100", "S", "C1", D("1"), D("0")), ("I2", "n", "002", "100", "S", "C1", D("1"), D("0")),
                  ("I1", "n", "001", "100", "S", None, D("1"), D("0"))], schema)
    batch = frame([("I1", "n", "001", "100", "S", "C1", D("9"), D("2"))], schema)
    assert rows(masters.update_special_inhouse(spcl, batch), "rate") == [(1,), (1,), (9,)]
    assert rows(masters.update_special_inhouse(spcl, batch, strict=False), "rate") == [(1,), (9,), (9,)]


def test_shares_move_from_the_main_payee(frame):
    shares = frame([("D1", 1, "D1", "n", "001", "B", "Clinician", "a", D("100")), ("D1", 2, "D1", "n", "002", "B", "Clinician", "a", D("100"))],
                   "code string, lineid int, u_paycode string, u_payname string, u_branch string, u_bname string, u_class string, "
                   "u_acntno string, u_share decimal(18,2)")
    branches = frame([("001", "A", "O", "O"), ("002", "B", "C", "O"), ("003", "C", "O", "O")],
                     "code string, blk string, stat string, slsstat string")
    batch = frame([("D1", "S1", D("20"), "sec", "Secretary", "x")],
                  "code string, pid string, share decimal(18,2), pname string, class string, acctno string")
    got = masters.share_redistribute(shares, batch, branches)
    assert rows(got, "u_paycode", "u_branch", "lineid", "u_share") == [
        ("D1", "001", 1, 80), ("D1", "002", 2, 100), ("S1", "001", 1, 20), ("S1", "003", 2, 20)]
    assert rows(masters.share_redistribute(got, batch, branches), "u_share") == rows(got, "u_share")


# --- change batches -------------------------------------------------------------------------

def test_upsert_is_idempotent_and_null_keys_never_match(frame):
    target = frame([("a", 1, "x"), (None, 2, "y")], "k string, v int, note string")
    batch = frame([("a", 5), ("b", 6)], "k string, v int")
    once = keyed.keyed_upsert(target, batch, ["k"], {"v": "v"})
    twice = keyed.keyed_upsert(once, batch, ["k"], {"v": "v"})
    want = ["('a', 5, 'x')", "('b', 6, None)", "(None, 2, 'y')"]
    assert sorted(map(str, (tuple(r) for r in once.collect()))) == want == sorted(map(str, (tuple(r) for r in twice.collect())))


def test_repeated_batch_key_fails_the_job(frame):
    target, batch = frame([("a", 1)], "k string, v int"), frame([("a", 5), ("a", 6)], "k string, v int")
    with pytest.raises(Exception, match="names a key twice"):
        keyed.keyed_update(target, batch, ["k"], {"v": "v"}).collect()


def test_numbering_is_contiguous_over_partitions(spark, frame):
    batch = spark.range(0, 5000, numPartitions=7).selectExpr("id", "id * 7919 % 5000 as r")
    numbered = keyed.number_rows(batch, ["r"], "n")
    assert numbered.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (1, 5000, 5000)
    assert numbered.where("n <> r + 1").count() == 0
    target = frame([(41, "x")], "id long, name string")
    added = keyed.append_with_identity(target, frame([("b",), ("a",)], "name string"), "id", ["name"])
    assert rows(added, "id", "name") == [(41, "x"), (42, "a"), (43, "b")]


def test_delete_existence_and_keys(frame):
    target = frame([("a", 1), ("b", None)], "k string, v int")
    assert rows(keyed.delete_where(target, F.col("v") == 1), "k") == [("b",)]
    batch = frame([("a",), ("z",)], "k string")
    assert rows(keyed.key_existence(target, batch, ["k"]), "k", "found") == [("a", 1), ("z", 0)]
    assert rows(keyed.insert_if_absent(target, batch, ["k"]), "k") == [("a",), ("b",), ("z",)]
    assert rows(normalise_keys(frame([("ab ",), ("AB",)], "k string"), "k").distinct(), "k") == [("AB",)]
