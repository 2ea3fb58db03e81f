"""Hand-made cases for the rating rules."""

from __future__ import annotations

from decimal import Decimal as D

import pytest

from remitloom.operators import rating as r
from remitloom.operators.banding import budget_gate, for_payment_flag, payee_scheme_banding
from remitloom.sources.bindings import bind

LINE = ("docentry long, linenum int, whscode string, itemcode string, u_labno string, cardcode string, u_doctorcode string, "
        "groupcode int, linetotal decimal(18,2), ratecomb string, rbprclvl int, rebrates decimal(18,2), genid int, "
        "u_packageno string, recondate date, docdate date")
SPCL = "itemcode string, whscode string, cardcode string, itemtype string, rate decimal(18,2), amt decimal(18,2)"
BOOK = "ratecode long, ratedesc string, type int, rate decimal(18,2), amount decimal(18,2)"


def line(frame, rows):
    full = [(d, n, "001", item, "L", card, doc, grp, D(amount), comb, lvl, D(own), 1, "", None, None)
            for d, n, item, card, doc, grp, amount, comb, lvl, own in rows]
    return frame(full, LINE)


def by_line(df):
    return {(x.docentry, x.linenum): x for x in df.collect()}


@pytest.fixture
def rates(frame):
    house = frame([("I1", "001", None, "S", D("12.50"), D("0")), ("I2", "001", "C9", "S", D("30"), D("0")),
                   ("I2", "001", "C1", "S", D("20"), D("7.40")), ("I3", "001", None, "S", D("0"), D("0"))], SPCL)
    book = frame([(2, "K", 102, D("9"), D("0")), (1, "K", 102, D("8"), D("0")), (3, "A", 100, D("4"), D("2")),
                  (4, "Z", 102, D("0"), D("0"))], BOOK)
    return house, book


def test_waterfall_tiers_and_rounding(frame, rates):
    lines = line(frame, [
        (1, 1, "I1", "C1", "D1", 102, "100", "K", 0, "0"),      # in-house first, 12.5 stored as 13
        (1, 2, "I9", "C1", "D1", 102, "100", "K", 0, "0"),      # dictionary, lowest code
        (1, 3, "I2", "C1", "D1", 100, "100", "A", 1, "6"),      # lowest account of two in-house rows
        (1, 4, "I9", "C1", "D1", 100, "100", "A", 1, "6"),      # own rate of the account
        (1, 5, "I3", "C1", "D1", 100, "100", "A", 1, "0"),      # two tiers pay nothing, dictionary does
        (1, 6, "I3", "C1", "D1", 100, "100", "none", 1, "0"),   # nothing pays: the last tier leaves its name
        (1, 7, "I3", "C1", "D1", 102, "100", "Z", 0, "0"),      # zero dictionary row overwrites the name
        (1, 8, "I9", "C1", "D1", 102, "100", None, 0, "0"),     # NULL key matches nothing
        (1, 9, "I1", "C1", "D1", 104, "100", "K", 1, "9")])     # no rule for other groups
    got = by_line(r.rate_waterfall(lines, *rates, None))
    assert [(x.comtype, x.rate, x.amt) for _, x in sorted(got.items())] == [
        ("CLI10001", 13, 0), ("CLI10002", 8, 0), ("ACC10001", 20, 7), ("ACC10002", 6, None), ("ACC10003", 4, 2),
        ("ACC10002", 0, 0), ("CLI10002", 0, 0), ("", None, None), ("", None, None)]
    exact = by_line(r.rate_waterfall(lines, *rates, None, scale=2))
    assert exact[1, 1].rate == D("12.50") and exact[1, 3].amt == D("7.40")


def test_small_rate_vanishes_when_stored_as_whole_number(frame, rates):
    house = frame([("I1", "001", None, "S", D("0.40"), D("0"))], SPCL)
    lines = line(frame, [(1, 1, "I1", "C1", "D1", 102, "100", "K", 0, "0")])
    assert by_line(r.rate_waterfall(lines, house, rates[1], None))[1, 1].comtype == "CLI10002"
    assert by_line(r.rate_waterfall(lines, house, rates[1], None, scale=2))[1, 1].comtype == "CLI10001"


def test_amounts_use_gross_and_round_once(frame, rates):
    lines = line(frame, [(1, 1, "I1", "C1", "D1", 102, "99.60", "K", 0, "0")])
    rated = r.rate_waterfall(lines, *rates, None)
    payees = frame([("D1", "D1", "Doc"), ("D1", "D1-S", "Sec"), ("X", "X", "Other")], "code string, pid string, pname string")
    sharing = frame([("D1", "D1", D("80"), D("5")), ("D1", "D1-S", D("20"), D("0"))],
                    "code string, pid string, rate decimal(18,2), fund decimal(18,2)")
    ocrd, odrs = frame([("D1",)], "cardcode string"), frame([("D1",)], "dcode string")
    split = r.payee_sharing_split(rated, payees, sharing, ocrd, odrs)
    got = {x.u_paycode: (x.linetotal, x.rebatesamnt, x.fund) for x in r.rebate_amounts(split).collect()}
    # 99.60 is stored as 100 and 12.5 % as 13 %
    assert got == {"D1": (100, D("10.40"), D("0.65")), "D1-S": (100, D("2.60"), D("0.00"))}
    exact = r.rebate_amounts(r.payee_sharing_split(r.rate_waterfall(lines, *rates, None, scale=2), payees, sharing, ocrd, odrs), 2)
    assert {x.u_paycode: x.rebatesamnt for x in exact.collect()} == {"D1": D("9.96"), "D1-S": D("2.49")}


def test_credits_and_installments_are_cut(frame):
    lines = line(frame, [(1, 1, "I1", "C", "D", 102, "10.00", "K", 0, "0"), (1, 2, "I1", "C", "D", 102, "5.00", "K", 0, "0"),
                         (2, 1, "I2", "C", "D", 102, "3.00", "K", 0, "0")])
    rin1 = frame([(1, 1, "L", "001", "I1", D("1.90")), (None, None, "L", "001", "I1", D("2.60"))],
                 "baseref long, baseline int, u_labno string, whscode string, itemcode string, linetotal decimal(18,2)")
    cm = {k: v.cm for k, v in by_line(r.credit_memo_net(lines, rin1)).items()}
    assert cm == {(1, 1): 3, (1, 2): 2, (2, 1): 0}          # 1 + 2.60 cut to 3; the loose credit hits both lines
    exact = {k: v.cm for k, v in by_line(r.credit_memo_net(lines, rin1, 2)).items()}
    assert exact == {(1, 1): D("4.50"), (1, 2): D("2.60"), (2, 1): D("0.00")}

    pay = frame([(1, 1, 7, D("3.70")), (1, 1, 8, D("9.00")), (1, 2, 9, D("5.00"))],
                "docentry long, linenum int, docnum long, linetotal decimal(18,2)")
    jdt1 = frame([("a", 7, 24), ("a", 7, 24), ("b", 8, 24), ("a", 9, 24)], "account string, baseref long, transtype int")
    oact = frame([("a", "40100"), ("b", "50000")], "acctcode string, segment_0 string")
    rct2 = frame([(7, 1), (8, 1), (9, 1)], "docnum long, docentry long")
    orct = frame([(7, "N"), (8, "N"), (9, "Y")], "docnum long, canceled string")
    ip = {k: v.ip for k, v in by_line(r.installment_paid(lines, pay, jdt1, oact, rct2, orct)).items()}
    assert ip == {(1, 1): 3, (1, 2): 0, (2, 1): 0}          # booked twice counts once; other account, cancelled: none
    both = r.net_positive_filter(r.installment_paid(r.credit_memo_net(lines, rin1), pay, jdt1, oact, rct2, orct))
    assert set(by_line(both)) == {(1, 1), (1, 2), (2, 1)}
    assert r.net_positive_filter(both.withColumn("ip", both.linetotal)).count() == 0


def test_unknown_values_are_not_excluded(frame):
    lines = line(frame, [(1, 1, "I", "C", None, 102, "1", "K", 0, "0"), (1, 2, "I", "C", "00", 102, "1", "K", 0, "0"),
                         (1, 3, "I", "C", "D9", 102, "1", "K", 0, "0"), (1, 4, "I", "C", "D9", 100, "1", "K", 1, "0"),
                         (1, 5, "I", "C", "D9", 100, "1", "K", 0, "0")])
    barred = frame([("D9", "102"), ("D1", "100")], "cardcode string, groupcode string")
    assert set(by_line(r.rebate_exclusions(lines, barred))) == {(1, 1), (1, 4)}


def banding_tables(frame):
    payees = frame([("P", "n", "c", None, None, "1", None, None, "CLINICIAN", None, None, None, 0, 1)],
                   "pid string, pname string, class string, acctnum string, add1 string, slpcode string, hosp string, telno string, "
                   "actype string, periodtype string, dispatchtype string, iscrosscheck int, isspecialtest int, isactive int")
    scheme = frame([(1, 1, "001", D("0"), D("999.99"), D("80"), D("500")), (2, 1, "001", D("1000"), D("9999"), D("90"), D("500"))],
                   "linenum int, payeetype int, whs string, rangefrom decimal(18,2), rangeto decimal(18,2), percnt decimal(18,2), "
                   "amntexclusion decimal(18,2)")
    codes = frame([("PayeeType", "1", "CLINICIAN")], "type string, code string, desc string")
    return payees, scheme, codes


def test_banding_and_flag(frame):
    totals = frame([(1, "P", "001", D("500")), (1, "P", "002", D("10")), (2, "P", "001", D("499.99")), (3, "P", "001", D("1000"))],
                   "genid int, u_paycode string, whscode string, rebatesamnt decimal(18,2)")
    got = {(x.genid, x.whscode): (x.percnt, x.amntexclusion, x.actualreb, x.payable)
           for x in payee_scheme_banding(totals, *banding_tables(frame)).collect()}
    # the threshold is inclusive; a branch without bands pays in full
    assert got == {(1, "001"): (80, 500, 400, 1), (1, "002"): (100, 0, 10, 1), (2, "001"): (80, 500, D("399.99"), 0),
                   (3, "001"): (90, 500, 900, 1)}
    flags = for_payment_flag(totals, *banding_tables(frame))
    assert {(x.genid, x.whscode): x.isforpayment for x in flags.collect()} == {
        (1, "001"): 1, (1, "002"): 1, (2, "001"): 0, (3, "001"): 1}


def test_gate_is_strict(frame):
    rows = frame([("P", "001", "X", D("600")), ("P", "001", "X", D("400")), ("P", "002", "X", D("0.01"))],
                 "u_paycode string, whscode string, actype string, rebate decimal(18,2)")
    limits = frame([("X", "001", D("1000"))], "accounttype string, whscode string, amntexcluded decimal(18,2)")
    got = {x.whscode: x.budgetstat for x in budget_gate(rows, limits, ["u_paycode", "whscode", "actype"]).collect()}
    assert got == {"001": 0, "002": 1}


def test_second_run_rates_nothing_and_single_runs_add_up(spark):
    t = bind(spark, "/root/testdata/sf0.001")
    first = r.rebate_generation(t, 1, "1995-01-01", "1995-01-31")
    again = r.rebate_generation(t, 2, "1995-01-01", "1995-01-31", ledger=first.ledger)
    assert first.details.count() == t.rac_rbdetailstrans.where("genid = 1").count() > 0
    assert again.details.count() == 0
    assert again.ledger.count() == first.ledger.count()
    assert [tuple(map(str, x)) for x in first.runs.collect()] == [("1", "1995-01-01", "1995-01-31", "1995-01-31", "None")]


def test_full_shares_preserve_the_line_amount(spark):
    t = bind(spark, "/root/testdata/sf0.001")
    wrong = (t.rac_rbdetailstrans.selectExpr("genid", "docentry", "linenum", "rebatesamnt",
                                             "linetotal * u_rate / 100 + coalesce(u_amount, 0) as whole")
             .groupBy("genid", "docentry", "linenum").agg({"rebatesamnt": "sum", "whole": "max"})
             .where("abs(`sum(rebatesamnt)` - `max(whole)`) > 0.02"))
    assert wrong.count() == 0
