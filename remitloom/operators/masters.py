"""Masters: clinicians, payees, shares, rates, items, and the lists built on them."""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import OPEN_END, day
from ..functions.money import or_zero, total
from ..functions.text import holds, labelled, optional, optional_contains, or_blank
from .commission import NO_REP, NO_REP_NAME
from .keyed import insert_if_absent, keyed_update, number_rows, unique_batch
from .product import product
from .skew import never_sent

# Defaults and names the masters use.
DEFAULT_PRICE_LEVEL = 3
CLINICIAN_TAG = 102
RATE_DIMENSIONS = ["pmode", "accttype", "senior", "pcktype", "prclvl", "whs", "testgrp"]
FULL_SHARE = Decimal("100.00")


# --- clinicians and reps ----------------------------------------------------------

class Retag(NamedTuple):
    tags: DataFrame
    clinicians: DataFrame
    payees: DataFrame
    changes: DataFrame


def rep_retag_scd2(tags: DataFrame, clinicians: DataFrame, payees: DataFrame, batch: DataFrame, as_of) -> Retag:
    """Give clinicians a new rep from a date (batch: dcode, dname, slpcode, taggeddate).

    Tagged by the 15th, the new interval starts in the tagged month and the old
    one ends the day before.  Later, the old one ends with the tagged month and
    the new one starts in the month after ``as_of``.  A clinician whose open
    interval already names the rep is left alone.  A clinician named twice ends
    the job.  ``changes`` are the rows that ``retag_log`` numbers.
    """
    values = [c for c in batch.columns if c != "dcode"]
    batch = unique_batch(batch, ["dcode"]).where("_hit").select("dcode", *[F.col(f"new_{c}").alias(c) for c in values])
    early = F.dayofmonth("taggeddate") <= 15
    first = F.trunc("taggeddate", "MM")
    wanted = batch.select(
        F.col("dcode").alias("bpcode"), F.col("dname").alias("new_name"), F.col("slpcode").alias("new_rep"),
        F.when(early, first).otherwise(F.trunc(F.add_months(day(as_of), 1), "MM")).alias("new_start"),
        F.when(early, F.date_sub(first, 1)).otherwise(F.last_day("taggeddate")).alias("old_end"))
    current = tags.where((F.col("stype") == CLINICIAN_TAG) & (F.col("edate") == day(OPEN_END)))
    same = current.select("bpcode", F.col("slpcode").alias("new_rep"))
    todo = wanted.join(same, ["bpcode", "new_rep"], "left_anti")
    closing = todo.select("bpcode", "old_end", F.lit(CLINICIAN_TAG).alias("stype"), day(OPEN_END).alias("edate"))
    closed = tags.join(closing, ["bpcode", "stype", "edate"], "left").select(
        *[F.coalesce("old_end", "edate").alias(c) if c == "edate" else F.col(c) for c in tags.columns])
    opened = todo.select(
        F.lit(CLINICIAN_TAG).alias("stype"), "bpcode", F.col("new_name").alias("bpname"),
        F.col("new_rep").alias("slpcode"), day(as_of).alias("encodedate"), F.col("new_start").alias("sdate"),
        day(OPEN_END).alias("edate"))
    who = todo.select(F.col("bpcode").alias("dcode"), F.col("new_rep").alias("slpcode"))
    before = current.groupBy("bpcode").agg(F.max("slpcode").alias("prev_rep"))
    changes = todo.join(before, "bpcode", "left").select(
        F.col("bpcode").alias("cardcode"), F.col("prev_rep").alias("from_rep"), F.col("new_rep").alias("to_rep"), F.lit("").alias("recom"),
        day(as_of).alias("modifydate"), F.col("new_rep").alias("remarks"), day(as_of).alias("effdate"), F.lit("").alias("updatedby"),
        F.lit("ODRS").alias("tbl"))
    return Retag(
        closed.unionByName(opened, allowMissingColumns=True),
        keyed_update(clinicians, who, ["dcode"], {"slpcode": "slpcode"}),
        keyed_update(payees, who.withColumnRenamed("dcode", "pid"), ["pid"], {"slpcode": "slpcode"}),
        changes)


def retag_log(changes: DataFrame, last_log: int = 0) -> DataFrame:
    """Log rows of a retag, numbered on from the last one of the log."""
    return number_rows(changes, ["cardcode"], "_n").withColumn("docentry", F.col("_n") + F.lit(last_log)).drop("_n")


def rep_tag_history(clinicians: DataFrame, tags: DataFrame, reps: DataFrame, code=None) -> DataFrame:
    """Tagging intervals of clinicians, oldest first."""
    own = tags.where(F.col("stype") == CLINICIAN_TAG).select(F.col("bpcode").alias("dcode"), "slpcode", "sdate",
                                                             "edate", "encodedate")
    return (optional(clinicians.select("dcode", "dname"), dcode=code).join(own, "dcode", "left")
            .join(reps.select("slpcode", F.upper("slpname").alias("slpname")), "slpcode", "left")
            .select("dcode", "dname", "slpcode", "slpname", "sdate", "edate", "encodedate").orderBy("dcode", "sdate"))


def clinician_list(clinicians: DataFrame, reps: DataFrame, name=None, shown: int | None = None) -> DataFrame:
    """Clinicians whose name contains the text; with ``shown``, the first by code."""
    rows = optional_contains(clinicians.withColumn("dname", or_blank("dname")), dname=name)
    text = ["hosp", "u_location", "add1", "sched", "specialization", "acctno", "phone1", "email", "remarks"]
    rep = F.coalesce(F.concat("slpcode", F.lit("-"), "slpname"), F.lit("NO SETUP"))
    rows = rows if shown is None else rows.orderBy("dcode").limit(shown)
    return rows.join(reps.select("slpcode", "slpname"), "slpcode", "left").select(
        or_blank("dcode").alias("dcode"), "dname", rep.alias("slpname"),
        F.when(F.col("slpname").isNotNull(), F.col("slpcode")).alias("slpcode"), *[or_blank(c).alias(c) for c in text])


# --- payees and shares --------------------------------------------------------------

class NewPayees(NamedTuple):
    payees: DataFrame
    shares: DataFrame


def _open_branches(branches: DataFrame, stat: str = "stat") -> DataFrame:
    return branches.where(F.col(stat) == "O").select("code", "blk")


def _per_branch(rows: DataFrame, branches: DataFrame) -> DataFrame:
    """Rows × branches."""
    return product(rows, branches.select(F.col("code").alias("u_branch"), F.col("blk").alias("u_bname")))


def share_expand_branches(clinicians: DataFrame, branches: DataFrame, shares: DataFrame) -> NewPayees:
    """New clinicians become payees with a full share in every open branch.

    Line numbers continue after the clinician's last one; a clinician has one
    row per branch, so the window groups are as small as the branch master.
    """
    payees = clinicians.select(
        F.col("dcode").alias("pid"), F.col("dname").alias("pname"), F.lit("Clinician").alias("class"),
        F.col("acctno").alias("acctnum"), "add1", "hosp", F.col("phone1").alias("telno"),
        F.lit("CLINICIAN").alias("actype"), F.lit("MONTHLY").alias("periodtype"))
    last = shares.groupBy("code").agg(F.max("lineid").alias("_last"))
    rows = _per_branch(clinicians.select(F.col("dcode").alias("code"), F.col("dname").alias("u_payname"),
                                         F.col("acctno").alias("u_acntno")), _open_branches(branches))
    nth = F.row_number().over(Window.partitionBy("code").orderBy("u_branch"))
    new = rows.join(last, "code", "left").select(
        "code", (F.coalesce("_last", F.lit(0)) + nth).alias("lineid"), F.col("code").alias("u_paycode"), "u_payname",
        "u_branch", "u_bname", F.lit("Clinician").alias("u_class"), "u_acntno",
        F.lit(FULL_SHARE).cast("decimal(18,2)").alias("u_share"))
    return NewPayees(payees, new)


def share_redistribute(shares: DataFrame, batch: DataFrame, branches: DataFrame, branch: str = "All",
                       existing: bool = False) -> DataFrame:
    """Share rows for payees in the branches they lack; the main payee of the code gives up that share there.

    ``batch``: code, pid, share and, for new payees, pname, class, acctno.
    ``existing`` takes name, class and account from the payee's first share row
    and uses the branches open for sales.
    """
    stat = "slsstat" if existing else "stat"
    where = _open_branches(branches, stat) if branch == "All" else branches.where(F.col("code") == branch).select(
        "code", "blk")
    rows = batch.select(F.col("code").alias("code_"), F.col("pid").alias("u_paycode"), F.col("share").alias("u_share_"),
                        *([] if existing else [F.col("pname").alias("u_payname"), F.col("class").alias("u_class"),
                                               F.col("acctno").alias("u_acntno")]))
    if existing:
        first = F.min(F.struct("lineid", "u_payname", "u_class", "u_acntno")).alias("t")
        template = shares.groupBy(F.col("code").alias("code_"), "u_paycode").agg(first).select(
            "code_", "u_paycode", "t.u_payname", "t.u_class", "t.u_acntno")
        rows = rows.join(template, ["code_", "u_paycode"])
    held = shares.select(*([F.col("code").alias("code_")] if existing else []), "u_paycode", "u_branch")
    missing = _per_branch(rows, where).join(held, held.columns, "left_anti")
    last = shares.groupBy("u_paycode").agg(F.max("lineid").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("u_paycode").orderBy("u_branch"))
    added = missing.join(last, "u_paycode", "left").select(
        F.col("code_").alias("code"), (F.coalesce("_last", F.lit(0)) + nth).alias("lineid"), "u_paycode", "u_payname",
        "u_branch", "u_bname", "u_class", "u_acntno", F.col("u_share_").cast("decimal(18,2)").alias("u_share"))
    given = added.groupBy("code", F.col("code").alias("u_paycode"), "u_branch").agg(total("u_share").alias("_given"))
    kept = shares.join(given, ["code", "u_paycode", "u_branch"], "left").select(
        *[(F.col("u_share") - or_zero("_given")).cast("decimal(18,2)").alias(c) if c == "u_share" else F.col(c)
          for c in shares.columns])
    return kept.unionByName(added)


def clinician_payees(shares: DataFrame, payees: DataFrame, reps: DataFrame, code=None) -> DataFrame:
    """Payees that share in a clinician, once each."""
    own = optional(shares, code=code).select("code", "u_paycode", "u_payname", F.upper("u_class").alias("u_class")
                                             ).distinct()
    who = payees.select(F.col("pid").alias("u_paycode"), "pid", "pname", "acctnum", "telno", "hosp", "add1", "actype",
                        "periodtype", "slpcode")
    return (own.join(who, "u_paycode", "left").join(reps.select("slpcode", "slpname"), "slpcode", "left")
            .select("code", "pid", "pname", "u_class", "acctnum", "telno", "hosp", "add1", "slpname", "actype",
                    "periodtype", F.when(F.col("slpname").isNotNull(), F.col("slpcode")).alias("slpcode")))


def payee_shares(shares: DataFrame, payee=None) -> DataFrame:
    return optional(shares, u_paycode=payee).select(
        "u_paycode", "u_payname", labelled("u_branch", "u_bname").alias("branch"), F.upper("u_class").alias("class"),
        "u_share", "u_branch")


def payee_lookup(payees: DataFrame, reps: DataFrame | None = None, pid=None) -> DataFrame:
    """Distinct active payees with their rep; without ``reps``, distinct payees that are no secretary."""
    rows = optional(payees, pid=pid)
    if reps is None:
        return rows.where(or_blank("class") != "Secretary").select("pid", "pname").distinct()
    return rows.where("isactive = 1").join(
        reps.select("slpcode", F.col("slpcode").alias("rep"), "slpname", "district"), "slpcode", "left").select(
        "actype", "class", "pid", "pname", "add1", F.col("rep").alias("slpcode"), "slpname", "district").distinct()


def payee_search(payees: DataFrame, reps: DataFrame, class_text=None, name_text=None, pid=None,
                 active: int = 1) -> DataFrame:
    """Payees by part of the class or name, or by id."""
    columns = ["pid", "pname", "class", "acctnum", "add1", "slpcode", "hosp", "telno", "actype", "periodtype",
               "dispatchtype", "iscrosscheck", "isspecialtest", "isactive"]
    rows = payees.where(F.col("isactive") == active)
    rows = rows if class_text is None else rows.where(holds("class", class_text))
    rows = rows if name_text is None else rows.where(holds("pname", name_text))
    rows = optional(rows, pid=pid).select(*columns).distinct()
    rep = F.upper(F.concat("slpcode", F.lit(" - "), "slpname"))
    return rows.join(reps.select("slpcode", "slpname"), "slpcode", "left").select(
        "pid", or_blank("pname").alias("pname"), or_blank(F.upper("class")).alias("class"),
        *[or_blank(c).alias(c) for c in ("acctnum", "telno", "hosp")], or_blank("add1").alias("address"),
        or_blank("slpname").alias("slpname"), or_blank(rep).alias("salesrep"), or_blank("actype").alias("payeetype"),
        or_blank("periodtype").alias("periodtype"), or_blank("slpcode").alias("slpcode"),
        or_blank("dispatchtype").alias("dispatch"), F.coalesce("iscrosscheck", F.lit(0)).alias("iscrosscheck"),
        F.coalesce("isspecialtest", F.lit(1)).alias("isspecialtest"), F.coalesce("isactive", F.lit(1)).alias("isactive"))


def _main_names(payees: DataFrame) -> DataFrame:
    """Name of the main payee of each code: the payee whose id is the code."""
    return payees.where(F.col("pid") == F.col("code")).groupBy(F.col("code").alias("_main")).agg(
        F.max("pname").alias("codename"))


def clinician_secretary_pairs(payees: DataFrame, sharing: DataFrame, reps: DataFrame, code=None,
                              from_class: str = "Clinician") -> DataFrame:
    """Clinicians with the secretaries of their code and both share rates.

    From the clinician's side every secretary of the code is shown; from the
    secretary's side (active payees only) the clinician whose id is the code.
    """
    rates = sharing.select("code", "pid", "rate", "fund")
    names = reps.select("slpcode", "slpname")
    clinicians = payees.where("class = 'Clinician'")
    secretaries = payees.where("class = 'Secretary'")
    if from_class == "Clinician":
        docs = optional(clinicians, code=code).join(rates, ["code", "pid"], "left")
        secs = optional(secretaries, code=code).join(rates, ["code", "pid"], "left").select(
            "code", F.col("pid").alias("sec"), F.col("pname").alias("sec_name"), F.col("rate").alias("sec_rate"))
        rows = docs.select("*", F.col("pid").alias("doc"), F.col("pname").alias("doc_name"),
                           F.col("rate").alias("doc_rate"), F.col("fund").alias("doc_fund"),
                           F.col("code").alias("of_code")).join(secs, "code", "left")
    else:
        docs = clinicians.where("isactive = 1").join(rates, ["code", "pid"], "left").select(
            F.col("pid").alias("code"), F.col("code").alias("of_code"), F.col("pname").alias("doc_name"),
            F.col("rate").alias("doc_rate"), F.col("fund").alias("doc_fund"))
        secs = optional(secretaries.where("isactive = 1"), pid=code).join(
            rates.drop("fund"), ["code", "pid"], "left")
        rows = secs.select("*", F.col("pid").alias("sec"), F.col("pname").alias("sec_name"),
                           F.col("rate").alias("sec_rate"), F.col("code").alias("doc")).join(docs, "code", "left")
    rows = rows.join(names, "slpcode", "left").join(_main_names(payees), F.col("_main") == F.col("of_code"), "left")
    return rows.select(
        or_blank("doc").alias("doccode"), or_blank("doc_name").alias("docname"), or_blank("sec").alias("seccode"),
        or_blank("sec_name").alias("secname"), or_blank("class").alias("class"),
        *[or_blank(c).alias(c) for c in ("acctnum", "telno", "hosp", "add1")],
        F.coalesce("slpcode", F.lit(NO_REP)).alias("slpcode"), F.coalesce("slpname", F.lit(NO_REP_NAME)).alias("slpname"),
        *[or_blank(c).alias(c) for c in ("actype", "periodtype", "dispatchtype")],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("iscrosscheck", "isspecialtest")],
        or_zero("doc_rate").alias("docrate"), or_zero("sec_rate").alias("secrate"), or_zero("doc_fund").alias("docfund"),
        F.col("of_code").alias("code"), "codename")


def add_payees(payees: DataFrame, sharing: DataFrame, batch: DataFrame) -> NewPayees:
    """Append payees; their share row only where (code, payee) has none."""
    rows = batch.drop("rate", "fund").withColumn("isactive", F.lit(1))
    return NewPayees(payees.unionByName(rows, allowMissingColumns=True),
                     insert_if_absent(sharing, batch.select("code", "pid", "rate", "fund"), ["code", "pid"]))


# --- schemes, levels and rates ------------------------------------------------------

def payee_scheme_list(scheme: DataFrame, codes: DataFrame, payee_type=None, whs=None) -> DataFrame:
    names = codes.where("type = 'PayeeType'").select(F.col("code"), F.col("desc").alias("name"))
    rows = optional(scheme, payeetype=payee_type, whs=whs).withColumn("code", F.col("payeetype").cast("string"))
    return rows.join(names, "code", "left").select("linenum", "code", "name", "whs", "rangefrom", "rangeto", "percnt",
                                                   "amntexclusion")


def scheme_detail(headers: DataFrame, lines: DataFrame, criteria: DataFrame, code=None) -> DataFrame:
    """Active lines of active schemes on active criteria."""
    heads = optional(headers.where("stat = 1"), schemecode=code).select("schemecode", "schemedesc", "whscode")
    return (heads.join(lines.where("stat = 1").drop("stat"), "schemecode")
            .join(criteria.where("stat = 1").drop("stat"), "criteriacode")
            .select("schemecode", "schemedesc", "whscode", "criteriadesc", "cash", "creditcard", "criteriacode")
            .orderBy("schemecode"))


def branch_scheme_list(branches: DataFrame, schemes: DataFrame, code=None) -> DataFrame:
    """The default row and every open branch with its scheme, or the branches of one scheme."""
    heads = schemes.select(F.col("whscode").alias("code"), "whscode", "schemecode")
    open_ = branches.where("stat = 'O'").select("code", "blk")
    rows = open_.join(heads, "code", "left") if code is None else open_.join(optional(heads, schemecode=code), "code")
    rows = rows.select("code", labelled("code", "blk").alias("whs"), "whscode")
    default = branches.sparkSession.range(1).select(
        F.lit("000").alias("code"), F.lit("000 - Default Rate").alias("whs"), F.lit("000").alias("whscode"))
    return default.unionByName(rows).distinct()


def branch_price_level(branches: DataFrame, price_hdr: DataFrame, levels: DataFrame, codes: DataFrame) -> DataFrame:
    """Open sales branches with price levels; branches without a level type get the default."""
    names = codes.where("module = 'RebRateMntnce' and `group` = 'PrcLvlType'").select(
        F.col("code").cast("int").alias("prclvltype"), "desc")
    hdr = price_hdr.where("pricetype = 'N'").select(F.col("company").alias("lisgrp"), "price_level1", "price_level2",
                                                    "price_level3")
    own = levels.select(F.col("whs").alias("code"), "prclvltype")
    return (branches.where("stat = 'O' and slsstat = 'O'").join(hdr, "lisgrp").join(own, "code", "left")
            .join(names, "prclvltype", "left")
            .select(F.coalesce("prclvltype", F.lit(DEFAULT_PRICE_LEVEL)).alias("prclvltype"),
                    or_blank("desc").alias("desc"), "code", "blk", "price_level1", "price_level2",
                    or_blank("price_level3").alias("price_level3")))


def account_price_level(accounts: DataFrame, accounts_ext: DataFrame, folders: DataFrame, invoices: DataFrame, since,
                        tagged: int | None = None, code=None, name=None) -> DataFrame:
    """Active accounts with a rate, invoiced after a date, with their price folder and tag.

    Only the existence of an invoice matters, so invoices filter as a semi join.
    """
    folder = folders.groupBy(F.col("dbcode").alias("cardcode")).agg(F.max("folder_id").alias("folder_id"))
    busy = invoices.where(F.col("docdate") > day(since)).select("cardcode")
    level = F.coalesce("rbprclvl", F.lit(0))
    rows = accounts.where((F.coalesce("rebrates", F.lit(0)) != 0) & (F.col("isactive") == 1)
                          & ~holds("u_cardname", "TESTING"))
    rows = rows if tagged is None else rows.where(level == tagged)
    rows = optional_contains(rows, cardcode=code, u_cardname=name)
    return (rows.join(accounts_ext.select("cardcode"), "cardcode").join(folder, "cardcode")
            .join(busy, "cardcode", "left_semi")
            .select("cardcode", "u_cardname", F.col("cardcode").alias("dbcode"), "rebrates",
                    or_blank("folder_id").alias("folder_id"), F.when(level == 0, "NOT TAG").otherwise("TAGGED").alias("rbprclvl"),
                    F.col("rbexpdt").alias("expirydate"), "rbdatetagged"))


def _rate_filters(rates: DataFrame, rate_type: int | None, filters: dict) -> Column:
    """Type equality and "column contains value" per given dimension."""
    keep = F.lit(True) if rate_type is None else F.col("type") == rate_type
    for dimension in RATE_DIMENSIONS:
        value = filters.get(dimension)
        if value is not None and value != "All":
            keep = keep & holds(dimension, value)
    return keep


def rate_combination_search(rates: DataFrame, pay_modes: DataFrame, account_types: DataFrame, codes: DataFrame,
                            branches: DataFrame, groups: DataFrame, rate_type: int | None = None,
                            shown: int | None = None, **filters) -> DataFrame:
    """Rates with their codes spelled out; with ``shown``, the first by rate code."""
    rows = rates.where(_rate_filters(rates, rate_type, filters))
    if shown is not None:
        rows = rows.orderBy("ratecode").limit(shown)

    def coded(group: str, column: str) -> DataFrame:
        return codes.where(F.col("group") == group).select(F.col("code").alias(column), F.col("desc").alias(f"{column}_t"))

    rows = (rows.join(pay_modes.select(F.col("u_paycode").alias("pmode"), F.col("u_paydesc").alias("pmode_t")), "pmode", "left")
            .join(account_types.select(F.col("acctcode").alias("accttype"), F.col("acctname").alias("accttype_t")),
                  "accttype", "left")
            .join(coded("Senior", "senior"), "senior", "left").join(coded("Package", "pcktype"), "pcktype", "left")
            .join(coded("PrcLvlType", "prclvl"), "prclvl", "left")
            .join(branches.select(F.col("code").alias("whs"), F.col("blk").alias("whs_t")), "whs", "left")
            .join(groups.select(F.col("tg_code").alias("testgrp"), F.col("tg_name").alias("testgrp_t")), "testgrp", "left"))
    return rows.select("ratecode", "ratedesc", *[F.col(f"{d}_t").alias(d) for d in RATE_DIMENSIONS], "rate", "amount",
                       "type")


def rate_bulk_update(rates: DataFrame, rate, amount, rate_type: int, **filters) -> DataFrame:
    """Set rate and amount of every row the search filters select."""
    hit = F.coalesce(_rate_filters(rates, rate_type, filters), F.lit(False))
    return rates.withColumns({
        c: F.when(hit, F.lit(v).cast("decimal(18,2)")).otherwise(F.col(c)) for c, v in (("rate", rate), ("amount", amount))})


def rate_batch_update(rates: DataFrame, batch: DataFrame, rate, amount, rate_type: int) -> DataFrame:
    """Set rate and amount where all seven dimensions equal a batch row; NULL never matches."""
    hit = batch.select(*RATE_DIMENSIONS).distinct().withColumn("_hit", F.lit(True))
    rows = rates.join(hit, RATE_DIMENSIONS, "left")
    take = F.coalesce(F.col("_hit") & (F.col("type") == rate_type), F.lit(False))
    new = {"rate": F.lit(rate).cast("decimal(18,2)"), "amount": F.lit(amount).cast("decimal(18,2)")}
    return rows.select(*[F.when(take, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
                         for c in rates.columns])


# --- items and customers --------------------------------------------------------------

def test_rate_list(item_h: DataFrame, item_d: DataFrame, rates: DataFrame, kind: str = "all", text: str = "",
                   whs=None, shown: int | None = None) -> DataFrame:
    """Test rates: ``all``, ``single`` tests without a package, or ``package`` tests; with ``shown``, the last codes first.

    Packages and rates stand once per item and branch, which no file size tells: they are shuffled, never sent.
    """
    items = optional(item_h.select("imh_code", "imh_desc", "whscode"), whscode=whs)
    packs = item_d.select(F.col("imd_pkg_code").alias("imh_code"), "whscode", F.col("imd_pkg_code"), "imd_pkg_item")
    prices = rates.select("imh_code", "whscode", F.col("imd_pkg_item").alias("r_item"), "rate", "amnt")
    keys = ["imh_code", "whscode"]
    if kind != "all":
        items = items.where(holds("imh_desc", text))
    if kind == "single":
        rows = items.join(never_sent(packs), keys, "left_anti").withColumns(
            {c: F.lit(None).cast("string") for c in ("imd_pkg_code", "imd_pkg_item")}).join(never_sent(prices), keys, "left")
    elif kind == "package":
        rows = items.join(never_sent(packs), keys).join(
            never_sent(prices.withColumnRenamed("r_item", "imd_pkg_item")), [*keys, "imd_pkg_item"], "left")
    else:
        rows = items.join(never_sent(packs), keys, "left").join(never_sent(prices), keys, "left")
    rows = rows.select("imh_code", "imh_desc", "imd_pkg_code", "imd_pkg_item", or_zero("rate").alias("rate"),
                       or_zero("amnt").alias("amnt"), "whscode").orderBy(F.desc("imh_code"), "whscode")
    return rows if shown is None else rows.limit(shown)


def special_test_search(spcl: DataFrame, accounts: DataFrame, item_code=None, item_text=None, card_code=None,
                        card_text=None, group=None, item_type=None, shown: int | None = None) -> DataFrame:
    """Special tests once per item, group, type and account; with ``shown``, the first by item."""
    names = accounts.select("cardcode", "cardname")
    rows = optional(spcl, itemcode=item_code, cardcode=card_code, grpcode=group, itemtype=item_type)
    rows = optional_contains(rows, itemname=item_text).join(names, "cardcode", "left")
    if card_text is not None:
        rows = rows.where(holds("cardname", card_text))
    rows = rows.select("itemcode", "itemname", "grpcode", "itemtype", "cardcode", or_blank("cardname").alias("cardname")
                       ).distinct()
    if shown is not None:
        rows = rows.orderBy("itemcode", "itemname", "grpcode", "itemtype", "cardcode").limit(shown)
    return rows.withColumn("itemtype", F.when(F.col("itemtype") == "S", "Single").otherwise("Package"))


def special_test_rates(spcl: DataFrame, accounts: DataFrame | None = None, item_code=None, item_name=None,
                       card_code=None, item_type=None) -> DataFrame:
    """Branch rates of special tests.

    With ``accounts`` (the detail screen), account and type match with NULL
    equal to ''.  Without, the account must be equal, so NULL finds nothing.
    """
    columns = ["itemcode", "itemname", "whscode", "rate", "amt", "grpcode", "itemtype", "cardcode"]
    rows = optional(spcl, itemcode=item_code, itemname=item_name).select(*columns)
    if accounts is None:
        return rows.where(F.col("cardcode") == F.lit(card_code)) if item_code is not None else rows.where("cardcode is not null")
    names = accounts.select("cardcode", "cardname")
    rows = rows.join(names.withColumn("known", F.col("cardcode")), "cardcode", "left")
    if item_code is not None:
        rows = rows.where((or_blank("known") == or_blank(F.lit(card_code))) & (or_blank("itemtype") == or_blank(F.lit(item_type))))
    return rows.select(*columns, or_blank("cardname").alias("cardname")).orderBy("itemcode", "cardcode", "whscode")


def item_search(items: DataFrame, item_h: DataFrame, item_type=None, code=None, text=None,
                shown: int | None = None) -> DataFrame:
    """Items not held in stock (S) and named packages (P); with ``shown``, the first by code."""
    single = items.where("invntitem = 'N'").select(F.col("itemcode").alias("code"), F.col("itemname").alias("desc"),
                                                   F.lit("S").alias("itemtype"))
    packs = item_h.where((F.col("imh_type") == "P") & (or_blank("imh_desc") != "")).select(
        F.col("imh_code").alias("code"), F.col("imh_desc").alias("desc"), F.lit("P").alias("itemtype"))
    rows = optional_contains(optional(single.unionByName(packs), itemtype=item_type), code=code, desc=text)
    return rows if shown is None else rows.orderBy("code", "itemtype").limit(shown)


def customer_search(accounts: DataFrame, group=None, code=None, text=None, shown: int | None = None) -> DataFrame:
    """Customers by group, code or part of the name; with ``shown``, the first by code."""
    rows = optional(accounts.where("cardtype = 'C'"), groupcode=group, cardcode=code)
    rows = optional_contains(rows, cardname=text).select(F.col("cardcode").alias("code"), F.col("cardname").alias("desc"))
    return rows if shown is None else rows.orderBy("code").limit(shown)


# --- drop-down lists ------------------------------------------------------------------

def code_list(table: DataFrame, code: Column | str, label: Column | str, where: Column | str | None = None,
              first: tuple[str, str] | None = None, distinct: bool = False, numeric: bool = False) -> DataFrame:
    """Code and label of a table, with an optional first row such as ('All', 'All')."""
    rows = table if where is None else table.where(where)
    rows = rows.select((F.col(code) if isinstance(code, str) else code).cast("string").alias("code"),
                       (F.col(label) if isinstance(label, str) else label).cast("string").alias("desc"),
                       F.lit(2).alias("seq"))
    if distinct:
        rows = rows.distinct()
    if first is not None:
        head = table.sparkSession.range(1).select(F.lit(first[0]).alias("code"), F.lit(first[1]).alias("desc"),
                                                  F.lit(1).alias("seq"))
        rows = head.unionByName(rows)
    order = F.col("code").try_cast("int") if numeric else F.col("code")
    return rows.orderBy("seq", order).drop("seq")


def update_special_inhouse(spcl: DataFrame, batch: DataFrame, strict: bool = True) -> DataFrame:
    """Rate and amount of in-house tests.

    ``strict`` matches every key.  Otherwise a batch row with an account hits
    all rows of that account, as AND binds before OR in the old condition.
    """
    if strict:
        keyed = batch.withColumn("cardcode", or_blank("cardcode"))
        rows = spcl.withColumn("_card", F.col("cardcode")).withColumn("cardcode", or_blank("cardcode"))
        done = keyed_update(rows, keyed, ["itemcode", "itemname", "whscode", "grpcode", "itemtype", "cardcode"],
                            {"rate": "rate", "amt": "amt"})
        return done.withColumn("cardcode", F.col("_card")).drop("_card")
    # several items of one account: every row of the account gets the values of the last item, as row after row did
    keyed = batch.where("cardcode is not null").groupBy("cardcode").agg(
        *[F.max_by(c, F.struct(*order)).alias(c) for order in [[c for c in ("itemcode", "whscode", "itemtype") if c in batch.columns] or ["rate"]]
          for c in ("rate", "amt")])
    return keyed_update(spcl, keyed, ["cardcode"], {"rate": "rate", "amt": "amt"})
