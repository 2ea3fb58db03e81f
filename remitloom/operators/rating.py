"""Rebate rating: from paid invoice lines to amounts per payee.

Shuffles of the line table are kept to one per key: account masters join on the
(much smaller) invoice headers, everything known per item and branch joins as
one profile, and everything known per payee code joins as one share table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day, day_span, month_start
from ..functions.money import at_scale, shared_amount
from ..functions.text import clean_code, or_blank
from ..sources.store import freeze
from .banding import for_payment_flag
from .skew import SLICE_ROWS, heavy_keys, never_sent, spread_join

# Codes the rating rules name.
CLINICIAN, ACCOUNT = 102, 100
EXCLUDED_PAY_TYPES = ["5", "6", "8"]
SUPPLY_BILL_CODES = ["5000", "5010"]
PROMO_ACCOUNT = "110019"
NO_CLINICIAN = "00"
REVENUE_SEGMENT = "40100"
RECEIPT_TYPE = 24
INVOICE_OBJECT = 13


def assign_run(headers: DataFrame, runs: DataFrame) -> DataFrame:
    """Give each invoice the first run whose dates cover it.

    Runs are spread over their days, so the date range becomes an equi join; a
    day in two runs belongs to the earlier one, as a second run skips lines the
    first has marked.
    """
    days = runs.select("genid", day_span("fdate", "tdate", "recondate")).groupBy("recondate").agg(
        F.min("genid").alias("genid"))
    return headers.join(days, "recondate")


def rebate_eligible_lines(oinv: DataFrame, inv1: DataFrame, ocrd_ext: DataFrame, ocrd: DataFrame,
                          prclvl: DataFrame, frm=None, to=None, ledger: DataFrame | None = None,
                          runs: DataFrame | None = None, gen_id: int | None = None) -> DataFrame:
    """Invoice lines that may earn a rebate, with the account and branch facts rating needs.

    Either one run (``frm``, ``to``, ``gen_id``) or many (``runs``).  Lines in
    ``ledger`` were rated before and are skipped; only its lines of the run's
    invoices are compared, and of a ledger stored by ``month`` (of the invoice)
    only the run's months are read.
    """
    heads = oinv.select("docentry", "cardcode", "cardname", "recondate", "docdate", F.col("whscode").alias("h_whs"),
                        "pmode")
    if runs is not None:
        heads = assign_run(heads, runs)
    else:
        heads = heads.where(F.col("recondate").between(day(frm), day(to))).withColumn("genid", F.lit(gen_id).cast("int"))
    senior = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in ("rbsenior", "member", "pwd")])
    accounts = (ocrd_ext.where("cardtype <> 'S'").select("cardcode", "groupcode").join(
        never_sent(ocrd.select("cardcode", F.when(senior == 1, 1).otherwise(0).alias("rbsenior"),
                               F.coalesce("rbprclvl", F.lit(0)).alias("rbprclvl"), "rebrates")), "cardcode"))
    levels = prclvl.select(F.col("whs").alias("h_whs"), "prclvltype")
    heads = heads.join(accounts, "cardcode").join(levels, "h_whs", "left").drop("h_whs")
    lines = inv1.where(
        (F.substring(or_blank("u_source"), 1, 2) != "HP") & ~F.col("u_paymenttyp").isin(EXCLUDED_PAY_TYPES)
    ).select("docentry", "linenum", "whscode", "itemcode", F.rtrim("u_labno").alias("u_labno"),
             F.rtrim("u_doctorcode").alias("u_doctorcode"), F.rtrim(or_blank("u_packageno")).alias("u_packageno"),
             "linetotal", "u_paymenttyp")
    rows = lines.join(never_sent(heads), "docentry")
    if ledger is None:
        return rows
    if runs is None and "month" in ledger.columns:
        ledger = ledger.where(F.col("month").between(month_start(day(frm)), month_start(day(to))))
    rated = of_documents(ledger.select("docentry", "linenum"), heads)
    return rows.join(never_sent(rated), ["docentry", "linenum"], "left_anti")


def of_documents(rows: DataFrame, heads: DataFrame | None, key: str = "docentry") -> DataFrame:
    """The rows of the documents in ``heads``; all rows without it."""
    if heads is None:
        return rows
    return rows.join(never_sent(heads.select(F.col("docentry").alias(key))), key, "left_semi")


def special_test_set(item_h: DataFrame, spcl_inhouse: DataFrame) -> DataFrame:
    """(item, branch) pairs that count as special: group SP, or listed in-house."""
    listed = spcl_inhouse.select(F.col("itemcode").alias("imh_code"), "whscode")
    sp = item_h.where("ti_test_grp = 'SP'").select("imh_code", "whscode")
    other = item_h.where("ti_test_grp <> 'SP'").select("imh_code", "whscode").join(
        never_sent(listed), ["imh_code", "whscode"], "left_semi")
    return sp.unionByName(other).distinct()


def inhouse_rates(spcl_inhouse: DataFrame, scale: int = 0) -> DataFrame:
    """One in-house rate per (item, branch): the lowest by account, type, rate, amount."""
    pick = F.min(F.struct("cardcode", "itemtype", "rate", "amt")).alias("pick")
    one = spcl_inhouse.groupBy("itemcode", "whscode").agg(pick)
    return one.select("itemcode", "whscode", *_priced("ih", F.col("pick.rate"), F.col("pick.amt"), scale))


def rate_book(rate_comb: DataFrame, scale: int = 0) -> DataFrame:
    """One dictionary rate per (type, key), the lowest code first."""
    pick = F.min(F.struct("ratecode", "rate", "amount")).alias("pick")
    one = rate_comb.groupBy(F.col("type").alias("b_type"), F.col("ratedesc").alias("b_desc")).agg(pick)
    return one.select("b_type", "b_desc", *_priced("b", F.col("pick.rate"), F.col("pick.amount"), scale))


def _priced(tag: str, rate: Column, amt: Column, scale: int) -> list[Column]:
    """Rate and amount as stored, whether they pay anything, and a mark that the row exists.

    Worked out on the rate tables, so that per line only flags are left to test.
    """
    rate, amt, zero = at_scale(rate, scale), at_scale(amt, scale), F.lit(0)
    pays = (F.coalesce(rate, zero) != 0) | (F.coalesce(amt, zero) != 0)
    return [rate.alias(f"{tag}_rate"), amt.alias(f"{tag}_amt"), pays.alias(f"{tag}_pays"), F.lit(True).alias(f"{tag}_hit")]


def rate_combination_key(lines: DataFrame, special: DataFrame, item_h: DataFrame,
                         inhouse: DataFrame | None = None) -> DataFrame:
    """Add ``ratecomb``, the key into the rate dictionary; NULL if any part is NULL.

    Item facts are put together per (item, branch) before the lines join them.
    """
    keys = ["itemcode", "whscode"]
    profile = (item_h.where(~F.col("imh_billcode").isin(SUPPLY_BILL_CODES))
               .select(F.col("imh_code").alias("itemcode"), "whscode", "ti_test_grp")
               .join(never_sent(special.select(F.col("imh_code").alias("itemcode"), "whscode", F.lit(True).alias("special"))),
                     keys, "left"))
    if inhouse is not None:
        profile = profile.join(never_sent(inhouse), keys, "left")
    pay = F.right(F.concat(F.lit("00"), F.col("u_paymenttyp").cast("string")), F.lit(2))
    package = F.when(F.col("u_packageno") == "", "0").when(F.col("special"), "3").otherwise("2")
    tail = [pay, F.col("rbsenior").cast("string"), package]
    clinician = F.concat(F.col("pmode").cast("string"), *tail, F.col("prclvltype").cast("string"),
                         F.col("whscode"), F.col("ti_test_grp"))
    account = F.concat(*tail, F.col("ti_test_grp"))
    return (lines.where(F.col("cardcode") != PROMO_ACCOUNT).join(never_sent(profile), keys)
            .withColumn("ratecomb", F.when(F.col("groupcode") == CLINICIAN, clinician).otherwise(account))
            .drop("special", "ti_test_grp"))


def rebate_exclusions(lines: DataFrame, no_rebate: DataFrame) -> DataFrame:
    """Drop lines without a clinician, of excluded clinicians, and of accounts without a level."""
    nobody = (F.col("groupcode") == CLINICIAN) & (F.col("u_doctorcode") == NO_CLINICIAN)
    no_level = (F.col("groupcode") == ACCOUNT) & (F.coalesce(F.col("rbprclvl"), F.lit(0)) == 0)
    kept = lines.where(~F.coalesce(nobody | no_level, F.lit(False)))
    barred = no_rebate.where("groupcode = '102'").select(F.col("cardcode").alias("barred")).distinct()
    return kept.join(barred, (F.col("u_doctorcode") == F.col("barred")) & (F.col("groupcode") == CLINICIAN), "left_anti")


def _stored(value: Column, scale: int) -> Column:
    """Credits and installments were stored as whole numbers: cut, not rounded."""
    cut = value.cast("bigint") if scale == 0 else value
    return cut.cast(f"decimal(18,{scale})")


def linked_credits(lines: DataFrame, rin1: DataFrame, scale: int = 0, heads: DataFrame | None = None) -> DataFrame:
    """Add ``cm_l``: credits that name the invoice line; with ``heads``, only those of its documents are summed."""
    linked = of_documents(rin1.where("baseline is not null"), heads, "baseref").groupBy(
        F.col("baseref").alias("docentry"), F.col("baseline").alias("linenum")).agg(
        _stored(F.sum("linetotal"), scale).alias("cm_l"))
    return lines.join(never_sent(linked), ["docentry", "linenum"], "left")


def loose_credits(lines: DataFrame, rin1: DataFrame, scale: int = 0, cases: DataFrame | None = None) -> DataFrame:
    """Add ``cm``: the linked credits plus those of the same branch, item and case; with ``cases``, only theirs are summed."""
    loose = rin1.where("baseline is null")
    if cases is not None:
        loose = loose.join(never_sent(cases.select("u_labno")), "u_labno", "left_semi")
    loose = loose.groupBy("whscode", "itemcode", "u_labno").agg(
        F.sum("linetotal").cast("decimal(18,2)").alias("cm_u"))
    first = F.coalesce(F.col("cm_l"), F.lit(0).cast(f"decimal(18,{scale})"))
    both = F.when(F.col("cm_u").isNull(), first).otherwise(_stored(first + F.col("cm_u"), scale))
    return lines.join(never_sent(loose), ["whscode", "itemcode", "u_labno"], "left").withColumn("cm", both).drop("cm_l", "cm_u")


def credit_memo_net(lines: DataFrame, rin1: DataFrame, scale: int = 0) -> DataFrame:
    """Add ``cm``, the credits of each line; with ``scale`` 0 fractions are cut after each step."""
    return loose_credits(linked_credits(lines, rin1, scale), rin1, scale)


def installment_paid(lines: DataFrame, aopdet2: DataFrame, jdt1: DataFrame, oact: DataFrame, rct2: DataFrame,
                     orct: DataFrame, scale: int = 0, heads: DataFrame | None = None) -> DataFrame:
    """Add ``ip``: installments of the line received on revenue accounts and not cancelled.

    With ``heads``, only receipts and installments of its documents are read into the sums.

    Receipts are reduced to distinct (receipt, invoice) pairs, then only filter
    the installments; the line table joins the finished sums once.
    """
    revenue = oact.where(F.col("segment_0") == REVENUE_SEGMENT).select("acctcode")
    booked = (jdt1.where(F.col("transtype") == RECEIPT_TYPE)
              .join(revenue, F.col("account") == F.col("acctcode"), "left_semi")
              .select(F.col("baseref").alias("docnum")))
    valid = orct.where("canceled = 'N'").select("docnum")
    receipts = (of_documents(rct2.select("docnum", "docentry"), heads).join(never_sent(booked), "docnum", "left_semi")
                .join(never_sent(valid), "docnum", "left_semi"))
    paid = of_documents(aopdet2, heads).join(never_sent(receipts), ["docentry", "docnum"], "left_semi").groupBy("docentry", "linenum").agg(
        _stored(F.sum("linetotal"), scale).alias("ip_sum"))
    return lines.join(never_sent(paid), ["docentry", "linenum"], "left").withColumn(
        "ip", F.coalesce(F.col("ip_sum"), F.lit(0).cast(f"decimal(18,{scale})"))).drop("ip_sum")


def net_positive_filter(lines: DataFrame, scale: int = 0) -> DataFrame:
    """Keep lines with something left after credits and installments (unknown amounts stay)."""
    net = at_scale(F.col("linetotal"), scale) - F.col("cm") - F.col("ip")
    return lines.where(F.coalesce(net > 0, F.lit(True)))


def rate_waterfall(lines: DataFrame, spcl_inhouse: DataFrame, rate_comb: DataFrame, ocrd: DataFrame,
                   scale: int = 0) -> DataFrame:
    """Add ``rate``, ``amt``, ``comtype`` and ``pays`` from the first tier that pays something.

    Clinicians: in-house rate (CLI10001), then dictionary (CLI10002).  Accounts:
    in-house (ACC10001), the account's own rate if tagged (ACC10002), then
    dictionary (ACC10003).  If no tier pays, the last one that applies leaves
    its name.  The account's own rate keeps the amount of the in-house tier.

    Each result is one short CASE over flags that came with the rate tables;
    nested conditions would outgrow what the JVM compiles for a whole stage.
    """
    if "ih_hit" not in lines.columns:
        lines = lines.join(never_sent(inhouse_rates(spcl_inhouse, scale)), ["itemcode", "whscode"], "left")
    if "rebrates" not in lines.columns:
        lines = lines.join(never_sent(ocrd.select("cardcode", "rebrates")), "cardcode", "left")
    rows = lines.join(rate_book(rate_comb, scale),
                      (F.col("b_type") == F.col("groupcode")) & (F.col("b_desc") == F.col("ratecomb")), "left")

    clinician, account = F.col("groupcode") == CLINICIAN, F.col("groupcode") == ACCOUNT
    own = at_scale(F.col("rebrates"), scale)
    tagged = account & (F.coalesce(F.col("rbprclvl"), F.lit(0)) != 0)
    own_pays = tagged & (own != 0)
    neither = ~(clinician | account)
    in_house = F.when(clinician, "CLI10001").otherwise("ACC10001")
    rate = (F.when(neither, None).when(F.col("ih_pays"), F.col("ih_rate")).when(own_pays, own)
            .when(F.col("b_hit"), F.col("b_rate")).when(tagged, own).otherwise(F.col("ih_rate")))
    amt = (F.when(neither, None).when(F.col("ih_pays") | own_pays, F.col("ih_amt"))
           .when(F.col("b_hit"), F.col("b_amt")).otherwise(F.col("ih_amt")))
    kind = (F.when(neither, "").when(F.col("ih_pays"), in_house).when(own_pays, "ACC10002")
            .when(F.col("b_hit"), F.when(clinician, "CLI10002").otherwise("ACC10003"))
            .when(tagged, "ACC10002").when(F.col("ih_hit"), in_house).otherwise(""))
    pays = F.coalesce(~neither & (F.col("ih_pays") | own_pays | F.col("b_pays")), F.lit(False))
    return rows.withColumns({"rate": rate, "amt": amt, "comtype": kind, "pays": pays}).drop(
        "b_type", "b_desc", "b_rate", "b_amt", "b_pays", "b_hit", "ih_rate", "ih_amt", "ih_pays", "ih_hit", "rebrates")


def holder_code() -> Column:
    """Whose shares a line pays: the account's or the clinician's."""
    return F.when(F.col("groupcode") == ACCOUNT, F.col("cardcode")).otherwise(F.col("u_doctorcode"))


def heavy_holders(oinv: DataFrame, inv1: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(key, slices) of accounts and clinicians with many lines, for ``payee_sharing_split``.

    Reads only the code columns: clinicians from the lines, accounts from the
    heads, a head counted as one line of two.  It holds for every period, as a
    holder has at least as many lines in all, so it can be stored beside the facts.
    """
    clinicians = inv1.select(F.lit(CLINICIAN).alias("g"), F.rtrim("u_doctorcode").alias("c"))
    accounts = oinv.select(F.lit(ACCOUNT).alias("g"), F.col("cardcode").alias("c")).withColumn(
        "two", F.explode(F.array(F.lit(1), F.lit(2)))).drop("two")
    return heavy_keys(clinicians.unionByName(accounts).where("c is not null"), ["g", "c"], slice_rows)


def payee_sharing_split(lines: DataFrame, payees: DataFrame, sharing: DataFrame, ocrd: DataFrame,
                        odrs: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """One row per line and payee: accounts share by account code, clinicians by clinician code.

    With ``heavy`` (from ``heavy_holders``) the lines of a heavy holder are
    dealt into slices, each joined to its own copy of the holder's shares.
    """
    shares = payees.select("code", "pid", "pname").join(
        never_sent(sharing.select("code", "pid", F.col("rate").alias("u_share"), F.col("fund").alias("u_fund"))), ["code", "pid"])
    holders = ocrd.select(F.lit(ACCOUNT).alias("s_group"), F.col("cardcode").alias("code")).unionByName(
        odrs.select(F.lit(CLINICIAN).alias("s_group"), F.col("dcode").alias("code")))
    per_holder = holders.join(never_sent(shares), "code").select(
        "s_group", "code", F.col("pid").alias("u_paycode"), F.col("pname").alias("u_payname"), "u_share", "u_fund")
    rated = lines.where("pays").drop("pays") if "pays" in lines.columns else lines.where(
        (F.coalesce("rate", F.lit(0)) != 0) | (F.coalesce("amt", F.lit(0)) != 0))
    if heavy is not None:
        return spread_join(rated, per_holder, {"s_group": F.col("groupcode"), "code": holder_code()}, ["docentry", "linenum"], heavy)
    return rated.join(never_sent(per_holder), (F.col("s_group") == F.col("groupcode")) & (F.col("code") == holder_code())).drop(
        "s_group", "code")


def rebate_amounts(split: DataFrame, scale: int = 0) -> DataFrame:
    """The rated detail rows with rebate and fund amounts."""
    line, share, fund = (at_scale(F.col(c), scale) for c in ("linetotal", "u_share", "u_fund"))
    return split.select(
        "genid", "docentry", "linenum", "u_packageno", "itemcode", clean_code("whscode").alias("whscode"), "cardcode",
        "u_labno", "u_doctorcode", "groupcode", "u_paycode", "comtype", F.lit(INVOICE_OBJECT).alias("objtype"),
        line.cast("decimal(18,2)").alias("linetotal"), F.col("rate").cast("decimal(18,2)").alias("u_rate"),
        F.col("amt").cast("decimal(18,2)").alias("u_amount"), share.cast("decimal(18,2)").alias("u_share"),
        "recondate", "docdate", F.lit(0).cast("decimal(18,2)").alias("dedamt"),
        shared_amount(line, F.col("rate"), F.col("amt"), share).alias("rebatesamnt"),
        shared_amount(line, F.col("rate"), F.col("amt"), fund).alias("fund"))


def rated_lines(t, frm=None, to=None, gen_id=None, runs=None, ledger=None, scale: int = 0) -> DataFrame:
    """Eligible lines with net amounts and rates: everything before the payee split.

    Steps that join by document come first, then those by item and branch, so
    the line table moves once for each of the two groups.
    """
    lines = rebate_eligible_lines(t.oinv, t.inv1, t.ocrd_ext, t.ocrd, t.rac_rebprclvlmntnce, frm, to, ledger, runs,
                                  gen_id)
    heads = None if runs is not None else t.oinv.where(F.col("recondate").between(day(frm), day(to))).select("docentry")
    lines = installment_paid(lines, t.aopdet2, t.jdt1, t.oact, t.rct2, t.orct, scale, heads)
    lines = rebate_exclusions(linked_credits(lines, t.rin1, scale, heads), t.rb_norebate)
    lines = rate_combination_key(lines, special_test_set(t.item_masterh, t.spclinhouse), t.item_masterh,
                                 inhouse_rates(t.spclinhouse, scale))
    cases = None if heads is None else of_documents(t.inv1.select("docentry", F.rtrim("u_labno").alias("u_labno")), heads)
    lines = net_positive_filter(loose_credits(lines, t.rin1, scale, cases), scale)
    return rate_waterfall(lines, t.spclinhouse, t.rac_rebratecombination, t.ocrd, scale)


def unflagged_details(t, heavy: DataFrame | None = None, **params) -> DataFrame:
    """Rated details before the payment flag."""
    lines = rated_lines(t, **params)
    split = payee_sharing_split(lines, t.rb_payees, t.rac_rbsharing, t.ocrd, t.odrs, heavy)
    return rebate_amounts(split, params.get("scale", 0))


def rebate_details(t, slice_rows: int | None = None, heavy: DataFrame | None = None, **params) -> DataFrame:
    """Rated details with the payment flag, for one run or for all runs at once.

    The flag needs the payee totals and the rows they came from.  The rows are
    written once in between: the chain of joins behind them costs far more than
    writing and scanning its result.  With ``slice_rows`` heavy holders and
    heavy payees of a branch are dealt into slices of about that many rows;
    ``heavy`` spares the search for holders.
    """
    if slice_rows is not None and heavy is None:
        heavy = heavy_holders(t.oinv, t.inv1, slice_rows)
    rows = freeze(unflagged_details(t, heavy=heavy, **params), "rated")
    return for_payment_flag(rows, t.rb_payees, t.rac_payeescheme, t.rac_maintenancecode, slice_rows)


def incremental_line_marking(details: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger of rated lines, extended by the lines that now have a detail."""
    return ledger.select("docentry", "linenum", "genid").unionByName(new_marks(details, ledger))


def new_marks(details: DataFrame, ledger: DataFrame) -> DataFrame:
    """The lines that now have a detail and are not in the ledger yet: what an append adds to it."""
    return details.groupBy("docentry", "linenum").agg(F.min("genid").alias("genid")).join(
        never_sent(ledger.select("docentry", "linenum")), ["docentry", "linenum"], "left_anti")


def monthly_marks(details: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``new_marks`` with the month of their invoice, the partition a large ledger is stored by.

    Of a ledger that has months only those of the details are compared.
    """
    marks = details.groupBy("docentry", "linenum").agg(F.min("genid").alias("genid"), month_start(F.min("recondate")).alias("month"))
    if ledger is None:
        return marks
    if "month" in ledger.columns:
        months = details.agg(F.collect_set(month_start(F.col("recondate"))).alias("m")).scalar()
        ledger = ledger.where(F.array_contains(months, F.col("month")))
    return marks.join(never_sent(ledger.select("docentry", "linenum")), ["docentry", "linenum"], "left_anti")


class Generation(NamedTuple):
    """What one rating run writes; ``marks`` is what an append adds to the ledger, ``ledger`` the whole of it."""

    details: DataFrame
    runs: DataFrame
    ledger: DataFrame
    marks: DataFrame


def rebate_generation(t, gen_id: int, frm, to, ledger: DataFrame | None = None, scale: int = 0,
                      slice_rows: int | None = None, heavy: DataFrame | None = None) -> Generation:
    """One run: its details, its run row and the extended ledger.  Rerunning rates nothing twice."""
    details = rebate_details(t, slice_rows, heavy, frm=frm, to=to, gen_id=gen_id, ledger=ledger, scale=scale)
    spark = details.sparkSession
    run = spark.range(1).select(
        F.lit(gen_id).cast("int").alias("genid"), day(frm).alias("fdate"), day(to).alias("tdate"),
        day(to).alias("asofdate"), F.lit(None).cast("date").alias("paymentdate"))
    empty = spark.createDataFrame([], "docentry long, linenum int, genid int")
    return Generation(details, run, incremental_line_marking(details, ledger if ledger is not None else empty), monthly_marks(details, ledger))
