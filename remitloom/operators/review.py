"""Review of rated details: totals per branch and payee, status changes, posting, and runs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day, day_span
from ..functions.money import ZERO, amount, or_zero, total
from ..functions.text import only_branches, optional, or_blank
from .banding import active_payees, payee_scheme_banding
from .commission import NO_REP, NO_REP_NAME
from .keyed import Changes, append_with_identity, keyed_update, touch
from .skew import never_sent

# States of a detail and of a cheque.
OPEN, APPROVED, POSTED = 0, 1, 2
PENDING = 3


def rebates_by_branch(details: DataFrame, payments: DataFrame, history: DataFrame, payees: DataFrame,
                      scheme: DataFrame, codes: DataFrame, budget: DataFrame, branches: DataFrame,
                      gen_id: int | None = None) -> DataFrame:
    """Per run and branch: sales, budget, rated, payable, paid and aged rebates, excess over budget.

    The details are read once, into totals per payee; everything else works on
    totals.
    """
    keys = ["genid", "whscode"]
    per_payee = optional(details, genid=gen_id).groupBy("genid", "u_paycode", "whscode", "isforpayment").agg(
        total("rebatesamnt").alias("rebatesamnt"))
    rated = per_payee.groupBy("genid", F.trim("whscode").alias("whscode")).agg(
        total("rebatesamnt").alias("rebatesamnt"))
    payable = (payee_scheme_banding(per_payee, payees, scheme, codes).where("isforpayment = 1")
               .groupBy(*keys).agg(total("actualreb").alias("computedreb")))
    aged = optional(history, genid=gen_id).groupBy(*keys).agg(total("amountpaid").alias("agedreb"))
    paid = optional(payments, genid=gen_id).groupBy(*keys).agg(total("actualrebates").alias("paidreb"))
    plan = budget.select(*keys, "sales", "budgetamnt")
    names = branches.select(F.col("code").alias("whscode"), "whsname")
    over = or_zero("paidreb") + or_zero("agedreb") - F.col("budgetamnt")
    return (rated.join(plan, keys, "left").join(names, "whscode", "left").join(payable, keys, "left")
            .join(aged, keys, "left").join(paid, keys, "left")
            .select(*keys, "whsname", or_zero("sales").alias("sales"), or_zero("budgetamnt").alias("budgetamnt"),
                    or_zero("rebatesamnt").alias("rebatesamnt"), or_zero("computedreb").alias("computedreb"),
                    or_zero("paidreb").alias("totactualreb"), or_zero("agedreb").alias("totagingreb"),
                    or_zero(F.greatest(F.lit(ZERO), over)).alias("excess")))


def rebates_detail(details: DataFrame, payees: DataFrame, reps: DataFrame, scheme: DataFrame, codes: DataFrame,
                   history: DataFrame, gen_id: int | None = None, whs=None) -> DataFrame:
    """Per run, payee, branch, flag and status: rebate total, band percentage, payable and aged amount."""
    rows = only_branches(optional(details, genid=gen_id), whs)
    sums = rows.groupBy("genid", "u_paycode", "whscode", "isforpayment", "stat").agg(
        total("rebatesamnt").alias("rebatesamnt"))
    banded = payee_scheme_banding(sums, payees, scheme, codes).drop("payable")
    aged = optional(history, genid=gen_id).groupBy("genid", "whscode", F.col("pcode").alias("u_paycode")).agg(
        total("amountpaid").alias("aged"))
    return (banded.join(reps.select("slpcode", "slpname"), "slpcode", "left")
            .join(aged, ["genid", "whscode", "u_paycode"], "left")
            .select(F.coalesce("stat", F.lit(OPEN)).alias("status"), "genid", "u_paycode", "pname", "add1", "class",
                    "actype", "periodtype", or_blank("slpcode").alias("slpcode"), or_blank("slpname").alias("slpname"),
                    "whscode", "rebatesamnt", "percnt", "amntexclusion", "actualreb",
                    or_zero("aged").alias("agingreb"), "isforpayment"))


def payee_rebates(details: DataFrame, payees: DataFrame, reps: DataFrame, gen_id: int | None = None,
                  stat: int = OPEN, branches=None) -> DataFrame:
    """Totals per run and payee of the details in one state, optionally for a list of branches."""
    rows = only_branches(optional(details, genid=gen_id), branches).where(F.coalesce("stat", F.lit(OPEN)) == stat)
    sums = rows.groupBy("genid", "u_paycode").agg(total("rebatesamnt").alias("rebatesamnt"))
    return (sums.join(active_payees(payees), F.col("pid") == F.col("u_paycode"), "left")
            .join(reps.select("slpcode", "slpname"), "slpcode", "left")
            .select("genid", "u_paycode", or_blank("pname").alias("pname"), or_zero("rebatesamnt").alias("rebatesamnt"),
                    or_blank("class").alias("class"), or_blank("add1").alias("add1"),
                    or_blank("acctnum").alias("acctnum"), F.coalesce("slpcode", F.lit(NO_REP)).alias("slpcode"),
                    F.coalesce("slpname", F.lit(NO_REP_NAME)).alias("slpname"), or_blank("hosp").alias("hosp"),
                    or_blank("periodtype").alias("periodtype"), or_blank("dispatchtype").alias("dispatchtype"),
                    F.coalesce("iscrosscheck", F.lit(0)).alias("iscrosscheck"),
                    F.coalesce("isspecialtest", F.lit(0)).alias("isspecialtest"), F.lit(0).alias("forpayment")))


class Posting(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    runs: DataFrame | None = None


def _headers(lines: DataFrame, tran_date, as_of) -> DataFrame:
    return lines.groupBy("pid", "iscrosscheck", "slpcode", "genid").agg(
        total("linetotal").alias("payment")).select(
        "pid", "payment", F.coalesce("iscrosscheck", F.lit(0)).alias("iscrosscheq"), day(tran_date if as_of is None else as_of).alias("recdate"),
        day(tran_date).alias("trandate"),
        "slpcode", F.lit(PENDING).alias("stat"), "genid")


def cheque_post(details: DataFrame, payees: DataFrame, tran_date, gen_id: int | None = None,
                branches=None, as_of=None) -> Posting:
    """Approved details as cheque headers per payee and cheque lines per branch, recorded on ``as_of``."""
    rows = only_branches(optional(details, genid=gen_id), branches).where(F.coalesce("stat", F.lit(OPEN)) == APPROVED)
    sums = rows.groupBy("genid", F.col("u_paycode").alias("pid"), "whscode", "isforpayment").agg(
        total("rebatesamnt").alias("linetotal"))
    who = active_payees(payees).select("pid", "iscrosscheck", "slpcode")
    return Posting(_headers(sums.join(who, "pid", "left"), tran_date, as_of),
                   sums.select("pid", "linetotal", "whscode", "genid"))


def cheque_post_run(rebates: DataFrame, payees: DataFrame, tran_date, dedupe: bool = True, as_of=None,
                    runs: DataFrame | None = None) -> Posting:
    """Posting from reviewed totals: approved, payable and not zero, aged amounts included.

    ``runs``, if given, come back with ``as_of`` as the payment date of every run in ``rebates``.

    ``dedupe=False`` keeps every payee row, so a payee listed twice is counted
    twice, as stored results of the old process were.
    """
    lines = rebates.where("status = 1 and isforpayment = 1 and actualreb + agingreb <> 0").select(
        F.col("u_paycode").alias("pid"), amount(F.col("actualreb") + F.col("agingreb")).alias("linetotal"), "whscode",
        "slpcode", "genid")
    who = payees.select("pid", "iscrosscheck")
    if dedupe:
        who = who.groupBy("pid").agg(F.max("iscrosscheck").alias("iscrosscheck"))
    dated = None if runs is None else date_runs(runs, rebates.select("genid"), tran_date if as_of is None else as_of)
    return Posting(_headers(lines.join(never_sent(who), "pid", "left"), tran_date, as_of),
                   lines.select("pid", "linetotal", "whscode", "genid"), dated)


def date_runs(runs: DataFrame, posted: DataFrame, as_of) -> DataFrame:
    """Runs with the payment date set where ``posted`` names the run."""
    known = posted.select("genid").distinct().withColumn("_posted", F.lit(True))
    return runs.join(known, "genid", "left").select(*[
        F.when(F.col("_posted"), day(as_of)).otherwise(F.col(c)).alias(c) if c == "paymentdate" else F.col(c) for c in runs.columns])


def of_runs(details: DataFrame, batch: DataFrame) -> DataFrame:
    """The details of the runs that a batch names; a change of those is written back by partition."""
    return details.join(batch.select("genid").distinct(), "genid", "left_semi")


def rebate_status_update(details: DataFrame, batch: DataFrame, keys: list[str],
                         assignments: dict[str, str | Column], only: Column | None = None) -> DataFrame:
    """Details with states set where the row matches the batch (and satisfies ``only``)."""
    if only is not None:
        guard = F.coalesce(only, F.lit(False))
        assignments = {
            c: F.when(guard, F.col("new_" + v) if isinstance(v, str) else v).otherwise(F.col(c))
            for c, v in assignments.items()}
    return keyed_update(details, batch, keys, assignments)


def changes_of_status(details: DataFrame, batch: DataFrame, update) -> Changes:
    """A status change (``approve_payees``, ``exclude_documents``) on details stored by run: only the batch's runs come back."""
    return touch(details, batch, "genid", lambda rows: update(rows, batch))


def approve_payees(details: DataFrame, batch: DataFrame) -> DataFrame:
    """Open details of the (run, payee, branch) keys become approved and payable."""
    return rebate_status_update(details, batch, ["genid", "u_paycode", "whscode"],
                                {"isforpayment": F.lit(1), "stat": F.lit(APPROVED)},
                                only=F.coalesce("stat", F.lit(OPEN)) == OPEN)


def exclude_documents(details: DataFrame, batch: DataFrame) -> DataFrame:
    """Details of the given (document, run) are excluded."""
    return rebate_status_update(details, batch, ["docentry", "genid"], {"isexcluded": F.lit(1)})


def mark_documents_for_payment(details: DataFrame, payees: DataFrame, payee_type: str, gen_id=None, branch=None,
                               payee=None) -> DataFrame:
    """Flag every detail of the selected documents; the match is by document alone, across payees and runs."""
    typed = payees.where(F.col("actype") == payee_type).select(F.col("pid").alias("u_paycode"))
    chosen = optional(only_branches(details, branch), genid=gen_id, u_paycode=payee).join(
        typed, "u_paycode", "left_semi").select("docentry").distinct()
    return rebate_status_update(details, chosen, ["docentry"], {"isforpaymnt": F.lit(1)})


# --- runs -----------------------------------------------------------------------

def runs_newest_first(runs: DataFrame) -> DataFrame:
    return runs.select(F.col("genid").alias("code"), F.col("genid").alias("desc")).orderBy(F.desc("code"))


def _next_label(runs: DataFrame) -> DataFrame:
    top = runs.agg((F.max("genid") + 1).alias("nxt"))
    return top.select("nxt", F.concat(F.lit("Next GenID - "), F.col("nxt").cast("string")).alias("desc"))


def generation_list(runs: DataFrame, unpaid_only: bool = False) -> DataFrame:
    """A row for the next run, then all (or the unpaid) runs, newest first."""
    shown = runs.where("paymentdate is null") if unpaid_only else runs
    first = _next_label(runs).select(F.lit(0).alias("code"), "desc", F.lit(1).alias("order"))
    rest = shown.select(F.col("genid").alias("code"), F.col("genid").cast("string").alias("desc"),
                        F.lit(2).alias("order")).distinct()
    return first.unionByName(rest).orderBy("order", F.desc("code"))


def generation_paid_list(runs: DataFrame, as_of) -> DataFrame:
    """The next run and all runs with their dates and whether they are paid."""
    nxt = _next_label(runs).select(F.col("nxt").alias("code"), "desc", day(as_of).alias("fdate"),
                                   day(as_of).alias("tdate"), F.lit(0).alias("ispaid"))
    known = runs.select(F.col("genid").alias("code"), F.col("genid").cast("string").alias("desc"), "fdate", "tdate",
                        F.when(F.col("paymentdate").isNull(), 0).otherwise(1).alias("ispaid"))
    return nxt.unionByName(known).orderBy(F.desc("code"))


def latest_unpaid_run(runs: DataFrame) -> DataFrame:
    top = runs.where("paymentdate is null").agg(F.max("genid").alias("g"))
    return runs.where(F.col("genid") == top.scalar()).select("genid", "fdate", "tdate")


def generation_labels(runs: DataFrame) -> DataFrame:
    """Runs with 'Month first - last, year'."""
    label = F.concat(F.date_format("fdate", "MMMM"), F.lit(" "), F.dayofmonth("fdate").cast("string"), F.lit(" - "),
                     F.dayofmonth("tdate").cast("string"), F.lit(", "), F.year("fdate").cast("string"))
    return runs.select(F.col("genid").alias("code"), F.col("genid").alias("desc"), label.alias("daterange")).orderBy(
        F.desc("code"))


def generation_schedule(runs: DataFrame, schedule: DataFrame, gen_id: int | None = None) -> DataFrame:
    """Runs with their schedule; yyyymmdd numbers and hhmmss text become dates and times."""
    digits = F.lpad(F.col("schedstarttime").cast("string"), 6, "0")
    clock = F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2))
    return optional(runs, genid=gen_id).join(schedule, "genid").select(
        "genid", "fdate", "tdate", "asofdate",
        F.to_date(F.col("schedstartdate").cast("string"), "yyyyMMdd").alias("schedstartdate"),
        F.to_date(F.col("schedenddate").cast("string"), "yyyyMMdd").alias("schedenddate"),
        clock.alias("schedstarttime"), "isenabled")


def commission_run_list(headers: DataFrame, as_of) -> DataFrame:
    """'UnProcess' as run 0, then the commission runs."""
    rest = headers.select(F.col("genid").alias("code"), F.col("genid").cast("string").alias("desc"), "datefrom",
                          "dateto")
    first = headers.sparkSession.range(1).select(F.lit(0).alias("code"), F.lit("UnProcess").alias("desc"),
                                                 day(as_of).alias("datefrom"), day(as_of).alias("dateto"))
    return first.unionByName(rest).distinct()


def generation_register(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Append runs; those with id 0 continue after the highest id."""
    named = runs.unionByName(new.where("genid <> 0"), allowMissingColumns=True)
    return append_with_identity(named, new.where("genid = 0").drop("genid"), "genid", ["fdate", "tdate"])


class ResetChanges(NamedTuple):
    """What a reset changes: runs to drop (with their details' partitions) and the ledger's touched partitions."""

    dropped: DataFrame
    ledger: Changes


def changes_of_reset(runs: DataFrame, ledger: DataFrame, oinv: DataFrame, batch: DataFrame) -> ResetChanges:
    """``generation_reset`` of the unpaid runs that a batch names, for tables stored by run.

    Their details are whole partitions and need not be read; of the ledger only
    their partitions are, and marks outside the run's dates stay.
    """
    dropped = runs.where("paymentdate is null").join(batch.select("genid").distinct(), "genid", "left_semi").select("genid", "fdate", "tdate")
    days = dropped.select("genid", day_span("fdate", "tdate", "recondate"))
    dated = oinv.select("docentry", "recondate").join(days, "recondate").select("genid", "docentry")
    left = touch(ledger, dropped, "genid", lambda rows: rows.join(dated, ["genid", "docentry"], "left_anti").select(*ledger.columns))
    return ResetChanges(dropped.select("genid"), left)


class Reset(NamedTuple):
    runs: DataFrame
    details: DataFrame
    ledger: DataFrame


def generation_reset(runs: DataFrame, details: DataFrame, ledger: DataFrame, oinv: DataFrame, gen_id: int,
                     force: bool = False, frm=None, to=None) -> Reset:
    """Withdraw a run: its row, its details and the marks on its lines.

    A paid run stays as it is, unless ``force``; the forced form unmarks every
    line in the given dates, whatever run marked it.
    """
    this = F.col("genid") == gen_id
    if force:
        gone = F.lit(True)
        dates = oinv.where(F.col("recondate").between(day(frm), day(to)))
        marks = ledger
    else:
        own = runs.where(this)
        gone = ~F.coalesce(own.agg(F.max(F.col("paymentdate").isNotNull())).scalar(), F.lit(False))
        span = own.agg(F.min("fdate").alias("f")), own.agg(F.max("tdate").alias("t"))
        dates = oinv.where(F.col("recondate").between(span[0].scalar(), span[1].scalar()))
        marks = ledger.where(this)
    drop = F.coalesce(this, F.lit(False)) & gone
    freed = marks.where(gone).join(dates.select("docentry"), "docentry", "left_semi").select("docentry", "linenum")
    return Reset(runs.where(~drop), details.where(~drop), ledger.join(freed, ["docentry", "linenum"], "left_anti"))
