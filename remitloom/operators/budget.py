"""Branch budgets and the gate that decides which rebates may be paid."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import AGE_LABELS, aging_bucket_pivot
from ..functions.dates import day, day_span, month_start
from ..functions.money import amount, or_zero, percent_of, ratio_percent, total
from ..functions.text import is_blank, only_branches, optional, or_blank
from .banding import budget_gate, gate_totals
from .keyed import keyed_update
from .skew import never_sent

# Share of sales a branch may pay out, and the sales ledger.
BUDGET_PERCENT = 2
SALES_SEGMENT = "40100"
# Sums are wider than the amounts they add up.
WIDE = "decimal(28,2)"

DOCUMENT_KEYS = ["docentry", "u_paycode", "u_labno", "cardcode", "whscode", "u_doctorcode", "groupcode"]


def rated_rows(details: DataFrame, payees: DataFrame, as_of=None, payee_type: str | None = None, branch=None,
               first_run: int | None = None, last_run: int | None = None, payee=None,
               unpaid_only: bool = False) -> DataFrame:
    """Rated details in a run range (open where no run is given) with the payee's type and rep.

    Every payee row of a code joins.  Naming a payee type makes the join inner.
    """
    rows = only_branches(details, branch).where(~is_blank("comtype"))
    if first_run is not None:
        rows = rows.where(F.col("genid") >= first_run)
    if last_run is not None:
        rows = rows.where(F.col("genid") <= last_run)
    if unpaid_only:
        rows = rows.where(F.coalesce("isforpaymnt", F.lit(0)) == 0)
    rows = optional(rows, u_paycode=payee)
    who = payees.select(F.col("pid").alias("u_paycode"), "actype", "slpcode")
    how = "left"
    if payee_type is not None:
        who, how = who.where(F.col("actype") == payee_type), "inner"
    rows = rows.join(never_sent(who), "u_paycode", how).withColumn("isexcluded", F.coalesce("isexcluded", F.lit(0)))
    return rows if as_of is None else rows.withColumn("ndys", F.datediff(day(as_of), "recondate"))


def payment_candidates(details: DataFrame, payees: DataFrame, criteria: DataFrame, reps: DataFrame, as_of,
                       payee_type: str, branch=None, first_run: int | None = 92, gen_id: int | None = 92,
                       min_amount=None) -> DataFrame:
    """Payees with enough unpaid rebates: amount that passes the gate, and its age over all branches.

    The details are summed once per (payee, branch, age in days); gate and age
    classes both start from those sums.
    """
    rows = rated_rows(details, payees, as_of, payee_type, branch, first_run, gen_id, unpaid_only=True)
    sums = rows.groupBy("u_paycode", "whscode", "actype", F.coalesce("isforpaymnt", F.lit(0)).alias("isforpaymnt"),
                        "ndys").agg(total("rebate").alias("rebate"))
    gated = budget_gate(sums, criteria, ["u_paycode", "whscode", "actype", "isforpaymnt"]).where("budgetstat = 1")
    budget = gated.groupBy("u_paycode", "actype", "isforpaymnt").agg(total("rebate").alias("budget"))
    ages = aging_bucket_pivot(sums, "ndys", "rebate", ["u_paycode"])
    if min_amount is not None:
        budget = budget.where(F.col("budget") > F.lit(min_amount).cast("decimal(18,2)"))
    who = payees.select(F.col("pid").alias("u_paycode"), "pname", "add1", "acctnum", "telno", "slpcode")
    return (budget.join(ages, "u_paycode", "left").join(never_sent(who), "u_paycode", "left")
            .join(reps.select("slpcode", F.col("slpcode").alias("rep"), "slpname"), "slpcode", "left")
            .select(F.col("u_paycode").alias("paycode"), F.coalesce("pname", F.lit("NO SETUP")).alias("payname"),
                    or_zero("budget").alias("budget"), *[or_zero(c).alias(c.lower()) for c in AGE_LABELS],
                    or_blank("add1").alias("add1"), or_blank("slpname").alias("slpname"),
                    or_blank("acctnum").alias("acctnum"), or_blank("telno").alias("telno"),
                    F.col("rep").alias("slpcode"), "actype", "isforpaymnt"))


def payment_detail_lines(details: DataFrame, payees: DataFrame, criteria: DataFrame, as_of, gen_id: int | None = None,
                         last_run: int | None = None, payee=None, branch=None) -> DataFrame:
    """Documents of a payee in this run and the next, or of all runs; here ``budgetstat`` 0 means the document passes."""
    last_run = last_run if gen_id is None or last_run is not None else gen_id + 1
    rows = rated_rows(details, payees, as_of, None, branch, gen_id, last_run, payee)
    gated = budget_gate(rows, criteria, [*DOCUMENT_KEYS, "actype", "ndys", "isexcluded"], passed=0, failed=1)
    return gated.groupBy(*DOCUMENT_KEYS, "ndys", "budgetstat", "isexcluded").agg(total("rebate").alias("rebate"))


def payee_branch_gate(details: DataFrame, payees: DataFrame, criteria: DataFrame, payee_type: str, payee=None,
                      first_run: int | None = 92, gen_id: int | None = 92, branch=None) -> DataFrame:
    """The gate per payee and branch."""
    rows = rated_rows(details, payees, None, payee_type, branch, first_run, gen_id, payee, unpaid_only=True)
    return budget_gate(rows, criteria, ["u_paycode", "whscode", "actype"])


def _payable_documents(details, payees, criteria, as_of, gen_id, branch, payee=None) -> DataFrame:
    rows = rated_rows(optional(details, genid=gen_id), payees, as_of, None, branch, payee=payee)
    keys = [*DOCUMENT_KEYS, "actype", "ndys", "isexcluded", "slpcode", "genid"]
    return budget_gate(rows, criteria, keys).where("budgetstat = 1 and isexcluded = 0")


def payment_header(details: DataFrame, payees: DataFrame, criteria: DataFrame, runs: DataFrame, as_of,
                   gen_id: int | None = None, branch=None) -> DataFrame:
    """Cheque headers from documents that pass the gate one by one and are not excluded."""
    documents = _payable_documents(details, payees, criteria, as_of, gen_id, branch)
    starts = runs.select("genid", F.col("fdate").alias("trandate"))
    return documents.join(starts, "genid", "left").groupBy("u_paycode", "slpcode", "trandate").agg(
        total("rebate").alias("payment")).select(
        "u_paycode", "payment", day(as_of).alias("recdate"), "trandate", "slpcode", F.lit(3).alias("stat"))


def payment_lines(details: DataFrame, payees: DataFrame, criteria: DataFrame, as_of, gen_id: int | None = None,
                  payee=None, branch=None) -> DataFrame:
    """Cheque lines per payee and branch of the same documents."""
    documents = _payable_documents(details, payees, criteria, as_of, gen_id, branch, payee)
    return documents.groupBy("u_paycode", "whscode").agg(total("rebate").alias("rebate"))


class BranchBudget(NamedTuple):
    header: DataFrame
    lines: DataFrame


def ledger_sales(jdt1: DataFrame, ojdt: DataFrame, oact: DataFrame) -> DataFrame:
    """Postings on sales accounts with their branch segment and date."""
    accounts = oact.where(F.col("segment_0") == SALES_SEGMENT).select("acctcode", "segment_1")
    return (jdt1.select("transid", "account", "credit", "debit")
            .join(accounts, F.col("account") == F.col("acctcode"))
            .join(ojdt.select("transid", "refdate"), "transid"))


def branch_budget_create(jdt1: DataFrame, ojdt: DataFrame, oact: DataFrame, details: DataFrame, payees: DataFrame,
                         criteria: DataFrame, runs: DataFrame, gen_id: int, first_run: int = 92) -> BranchBudget:
    """Ledger sales of the run, a 2 % budget and the rebates that pass the gate, per branch.

    The header's rebate total is taken before the gate.
    """
    run = runs.where(F.col("genid") == gen_id)
    start, end = run.agg(F.min("fdate").alias("d")).scalar(), run.agg(F.max("tdate").alias("d")).scalar()
    dated = ojdt.where(F.col("refdate").between(start, end))
    sales = ledger_sales(jdt1, dated, oact).groupBy("segment_1").agg(
        (total("credit") - total("debit")).cast(WIDE).alias("sales"))
    rows = rated_rows(details, payees, None, None, None, first_run, gen_id, unpaid_only=True)
    gated = budget_gate(rows, criteria, ["u_paycode", "whscode", "actype"])
    rebates = gated.where("budgetstat = 1").groupBy("whscode").agg(total("rebate").alias("passed"))
    g = F.lit(gen_id).cast("int").alias("genid")
    lines = sales.join(rebates, F.col("segment_1") == F.col("whscode"), "left").select(
        g, F.col("segment_1").alias("whscode"), "sales", F.lit(BUDGET_PERCENT).cast("decimal(18,2)").alias("percnt"),
        percent_of(F.col("sales"), F.lit(BUDGET_PERCENT)).cast(WIDE).alias("budgetamt"),
        or_zero("passed").alias("rebates"))
    ungated = gated.agg(total("rebate").alias("r"))
    header = sales.agg(F.sum("sales").cast(WIDE).alias("totalsales")).select(
        g, start.alias("startdate"), end.alias("enddate"), "totalsales",
        or_zero(ungated.scalar()).alias("totalrebate"))
    return BranchBudget(header, lines)


def prefix_gate(details: DataFrame, payees: DataFrame, criteria: DataFrame, first_run: int | None = None) -> DataFrame:
    """(genid, whscode, passed, open): by how much each run changes what passes the gate, and what is open, in a branch.

    The gate of a run looks at everything unpaid from the first run up to it.
    Sums per payee, branch and run are added up over the runs once; a run's
    share of what passes is what its sum lets through less what the sum before
    let through, so adding the shares up to a run gives its total.  The windows
    hold one row a run.
    """
    rows = rated_rows(details, payees, first_run=first_run, unpaid_only=True)
    keys = ["u_paycode", "whscode", "actype"]
    sums = rows.groupBy(*keys, "genid").agg(total("rebate").cast(WIDE).alias("own"))
    so_far = F.sum("own").over(Window.partitionBy(*keys).orderBy("genid"))
    gated = gate_totals(sums.withColumn("rebate", so_far.cast(WIDE)), criteria)
    limit, now, before = F.col("amntexcluded"), F.col("rebate"), F.col("rebate") - F.col("own")
    let = lambda amount_: F.when(amount_ > limit, amount_).otherwise(F.lit(0))
    return gated.groupBy("genid", "whscode").agg(F.sum(let(now) - let(before)).cast(WIDE).alias("passed"), F.sum("own").cast(WIDE).alias("open"))


def branch_budgets(jdt1: DataFrame, ojdt: DataFrame, oact: DataFrame, details: DataFrame, payees: DataFrame, criteria: DataFrame,
                   runs: DataFrame, first_run: int | None = None) -> BranchBudget:
    """``branch_budget_create`` for every run in one job.

    Ledger dates are spread over the runs that cover them, then summed per run
    and branch; what passes the gate is added up over the runs of a branch.
    """
    spans = runs.select("genid", day_span("fdate", "tdate", "refdate"))
    sales = ledger_sales(jdt1, ojdt, oact).join(spans, "refdate").groupBy("genid", F.col("segment_1").alias("whscode")).agg(
        (total("credit") - total("debit")).cast(WIDE).alias("sales"))
    shares = prefix_gate(details, payees, criteria, first_run)
    steps = sales.select("genid", "whscode", "sales", F.lit(None).cast(WIDE).alias("passed")).unionByName(
        shares.select("genid", "whscode", F.lit(None).cast(WIDE).alias("sales"), "passed")).groupBy("genid", "whscode").agg(
        F.max("sales").alias("sales"), F.sum("passed").alias("passed"))
    up_to = F.sum("passed").over(Window.partitionBy("whscode").orderBy("genid"))
    lines = steps.withColumn("passed", up_to.cast(WIDE)).where("sales is not null").select(
        "genid", "whscode", "sales", F.lit(BUDGET_PERCENT).cast("decimal(18,2)").alias("percnt"),
        percent_of(F.col("sales"), F.lit(BUDGET_PERCENT)).cast(WIDE).alias("budgetamt"), or_zero("passed").cast(WIDE).alias("rebates"))
    # one entry a run, so an array of them is as small as the table of runs
    opened = shares.groupBy("genid").agg(F.sum("open").cast(WIDE).alias("open")).agg(F.collect_list(F.struct("genid", "open")).alias("o")).scalar()
    so_far = F.aggregate("_opened", F.lit(0).cast(WIDE), lambda sum_, o: (sum_ + F.when(o["genid"] <= F.col("genid"), o["open"]).otherwise(F.lit(0))).cast(WIDE))
    sold = sales.groupBy("genid").agg(F.sum("sales").cast(WIDE).alias("totalsales"))
    header = runs.join(sold, "genid", "left").withColumn("_opened", opened).select(
        "genid", F.col("fdate").alias("startdate"), F.col("tdate").alias("enddate"), "totalsales", or_zero(so_far).alias("totalrebate"))
    return BranchBudget(header, lines)


def replace_budget(stored: DataFrame, fresh: DataFrame, gen_id: int) -> DataFrame:
    """The stored budget table with one run's rows replaced."""
    return stored.where(F.col("genid") != gen_id).unionByName(fresh, allowMissingColumns=True)


def budget_summary(headers: DataFrame, lines: DataFrame, gen_id: int | None = None, month=None) -> DataFrame:
    """Totals per run and rebates in percent of sales, for one run, one month or all."""
    heads = optional(headers, genid=gen_id).select("genid", "startdate", "enddate")
    if month is not None:
        heads = heads.where(F.col("startdate") == month_start(day(month)))
    sums = heads.join(lines, "genid").groupBy("genid", "startdate", "enddate").agg(
        total(or_zero("sales")).alias("s"), total(or_zero("budgetamt")).alias("b"),
        total(or_zero("rebates")).alias("r"))
    return sums.select("genid", "startdate", "enddate", F.col("s").cast(WIDE).alias("totalsales"),
                       F.col("b").cast(WIDE).alias("totalbudget"), F.col("r").cast(WIDE).alias("totalrebate"),
                       (F.col("b") - F.col("r")).cast(WIDE).alias("totalexcess"),
                       ratio_percent(F.col("r"), F.col("s")).alias("totalprcnttosales"))


def branch_budget_detail(lines: DataFrame, branches: DataFrame, gen_id: int | None = None) -> DataFrame:
    """Excess and percent of sales per branch; branches without sales get no percentage."""
    names = branches.select(F.col("code").alias("whscode"), "blk")
    return optional(lines, genid=gen_id).join(names, "whscode", "left").select(
        F.rtrim("whscode").alias("branchcode"), F.col("blk").alias("branchname"), "sales",
        or_zero("percnt").alias("percnt"), or_zero("budgetamt").alias("budgamt"), or_zero("rebates").alias("rebates"),
        amount(or_zero("budgetamt") - or_zero("rebates")).alias("excess"),
        ratio_percent(or_zero("rebates"), or_zero("sales")).alias("percntofactsales"), "genid").orderBy("branchcode")


def budget_repercent(lines: DataFrame, batch: DataFrame) -> DataFrame:
    """New percentages per (run, branch); the budget amount follows."""
    return keyed_update(lines, batch, ["genid", "whscode"], {
        "percnt": "percnt",
        "budgetamt": percent_of(F.col("sales"), F.col("new_percnt"))})


def hierarchy_repercent(budget: DataFrame, batch: DataFrame) -> DataFrame:
    """New percentages in the budget hierarchy; amount and excess follow."""
    new = percent_of(F.col("sales"), F.col("new_prcent"))
    excess = F.when(new - F.col("rebates") >= 0, F.lit(0)).otherwise(F.abs(new - F.col("rebates")))
    return keyed_update(budget, batch, ["genid", "whscode"],
                        {"prcent": "prcent", "budgetamnt": new, "excesstobudget": amount(excess)})


def budget_remaining(details: DataFrame, payees: DataFrame, lines: DataFrame, payee_type: str, branch=None,
                     gen_id: int | None = None) -> DataFrame:
    """Budget per run, less the rebates of that run already paid."""
    rows = rated_rows(optional(details, genid=gen_id), payees, None, payee_type, branch)
    paid = rows.where(F.coalesce("isforpaymnt", F.lit(0)) == 1).groupBy("genid").agg(total("rebate").alias("paid"))
    plan = only_branches(optional(lines, genid=gen_id), branch).groupBy("genid").agg(
        or_zero(total("sales")).alias("totsales"), or_zero(total("budgetamt")).alias("totbudget"))
    return plan.join(paid, "genid", "left").select(
        "totsales", amount(F.col("totbudget") - or_zero("paid")).alias("totbudget"), "genid")


def budget_hierarchy(sales: DataFrame, details: DataFrame, branches: DataFrame,
                     gen_id: int | None = None) -> DataFrame:
    """Budget per run and branch against the unpaid rebates of the run and the one before.

    Rebates are summed per run first; each sum then counts for two runs.
    """
    rows = details.where(~is_blank("comtype") & (F.coalesce("isforpaymnt", F.lit(0)) == 0))
    if gen_id is not None:
        rows = rows.where(F.col("genid").between(gen_id - 1, gen_id))
    per_run = rows.groupBy("genid", "whscode").agg(total(or_zero("rebate")).alias("rebate"))
    rebates = per_run.withColumn("genid", F.explode(F.array("genid", F.col("genid") + 1))).groupBy(
        "genid", "whscode").agg(total("rebate").alias("rebates"))
    names = branches.select(F.col("code").alias("whscode"), "whsname")
    budget = percent_of(F.col("sales"), F.lit(BUDGET_PERCENT))
    excess = F.when(budget - F.col("rebates") >= 0, F.lit(0)).otherwise(F.abs(budget - F.col("rebates")))
    return (optional(sales, genid=gen_id).join(rebates, ["genid", "whscode"], "left")
            .join(names, "whscode", "left")
            .select("genid", "whscode", "whsname", "sales",
                    F.lit(BUDGET_PERCENT).cast("decimal(18,2)").alias("prcent"), budget.alias("budgetamnt"), "rebates",
                    amount(excess).alias("excesstobudget"),
                    ratio_percent(F.col("rebates"), F.col("sales")).alias("prcnttosales")))


def budget_hierarchy_list(budget: DataFrame, branches: DataFrame, gen_id: int | None = None) -> DataFrame:
    names = branches.select(F.col("code").alias("whscode"), "whsname")
    zero = ("sales", "budgetamnt", "rebates", "excesstobudget", "prcnttosales")
    return optional(budget, genid=gen_id).join(names, "whscode", "left").select(
        "whscode", "whsname", "prcent", "genid", *[or_zero(c).alias(c) for c in zero])


def budget_criteria_fill(criteria: DataFrame, branches: DataFrame, types: list[str], threshold,
                         whs: str = "All") -> DataFrame:
    """The threshold rows missing for the given account types, for all open branches or one."""
    open_ = optional(branches.where("stat = 'O'") if whs == "All" else branches, code=whs)
    wanted = open_.select(F.explode(F.array(*[F.lit(x) for x in types])).alias("accounttype"),
                          F.col("code").alias("whscode"))
    return wanted.join(criteria, ["accounttype", "whscode"], "left_anti").withColumn(
        "amntexcluded", F.lit(threshold).cast("decimal(18,2)"))


def budget_criteria_list(criteria: DataFrame, branches: DataFrame, account_type=None, whs=None) -> DataFrame:
    names = branches.select(F.col("code").alias("whscode"), "whsname")
    rows = optional(criteria, accounttype=account_type or None, whscode=whs or None)
    return rows.join(names, "whscode", "left").select("accounttype", "whscode", "whsname", "amntexcluded")


