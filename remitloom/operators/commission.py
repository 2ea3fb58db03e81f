"""Salesperson commissions: invoice lines, the rep in charge on the date, and payout."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import OPEN_END, day, month_label, month_start, years_apart
from ..functions.money import amount, or_zero, percent_of, total
from ..functions.text import is_blank, optional, or_blank
from ..sources.store import freeze
from .product import product
from .skew import never_sent

# Codes the commission rules name.
COMMISSION_PAY_TYPES = ["1", "3", "5", "7"]
EXCLUDED_ACCOUNT_TYPE = "06"
MISSION_ACCOUNT_TYPE = "04"
SALES_DEPARTMENT = 18
NO_REP, NO_REP_NAME = "-1", "-No Sales Employee-"

FACT_KEYS = ["docentry", "labno", "cardcode", "docdate", "itemcode", "u_packageno", "whscode", "pmode",
             "u_doctorcode", "u_paymenttyp", "linenum"]


def invoice_line_fact(oinv: DataFrame, inv1: DataFrame, rin1: DataFrame, aopdet2: DataFrame, frm=None, to=None,
                      pay_types=COMMISSION_PAY_TYPES, marks: DataFrame | None = None) -> DataFrame:
    """Invoice lines with credits and payments, both summed before they join.

    A credit counts in full against every line of the same case, branch and item.
    A period keeps only its invoices' lines before anything else joins, and only
    the payments of its documents and the credits of its cases are summed; all
    of history takes the credits first, so that everything by document, the last
    sum included, needs one more move of the lines.  Lines in ``marks`` are skipped.
    """
    heads = oinv.select("docentry", "labno", "cardcode", "docdate", "whscode", "pmode")
    if frm is not None:
        heads = heads.where(F.col("docdate").between(day(frm), day(to)))
    lines = inv1.where(F.col("u_paymenttyp").isin(list(pay_types))).select(
        "docentry", "linenum", "itemcode", "u_packageno", "u_doctorcode", "u_paymenttyp", "u_labno",
        F.col("whscode").alias("l_whs"), "linetotal")
    if frm is not None:
        documents = never_sent(heads.select("docentry"))
        cases = lines.join(documents, "docentry", "left_semi").select("u_labno")
        rin1 = rin1.join(never_sent(cases), "u_labno", "left_semi")
        aopdet2 = aopdet2.join(documents, "docentry", "left_semi")
    credits = rin1.groupBy("u_labno", F.col("whscode").alias("l_whs"), "itemcode").agg(total("linetotal").alias("adj"))
    paid = aopdet2.groupBy("docentry", "linenum").agg(total("linetotal").alias("pay"))
    if frm is None:
        lines = lines.join(never_sent(credits), ["u_labno", "l_whs", "itemcode"], "left")
    rows = lines.join(never_sent(heads), "docentry")
    if marks is not None:
        rows = rows.join(never_sent(marks.select("docentry", "linenum", "itemcode")), ["docentry", "linenum", "itemcode"], "left_anti")
    rows = rows.join(never_sent(paid), ["docentry", "linenum"], "left")
    if frm is not None:
        rows = rows.join(never_sent(credits), ["u_labno", "l_whs", "itemcode"], "left")
    sums = rows.groupBy(*FACT_KEYS).agg(
        total("linetotal").alias("amount"), or_zero(total("adj")).alias("adjamt"), or_zero(total("pay")).alias("paid"),
        F.sum(F.col("linetotal") - or_zero("adj")).alias("_net"))
    return sums.where("_net <> 0").drop("_net")


def special_item_set(item_master: DataFrame) -> DataFrame:
    """Distinct (code, type, group) of special items; a code with two types stays twice."""
    return item_master.where("ti_test_grp = 'SP'").select("imh_code", "imh_type", "ti_test_grp").distinct()


def account_segment(lines: DataFrame, ocrd: DataFrame, odrs: DataFrame, special: DataFrame,
                    heads: DataFrame | None = None) -> DataFrame:
    """Net amount, account segment (``hospital``) and test group of each line.

    With ``heads``, the documents of the lines, accounts go to the documents
    first: lines that lie by document then meet them without another move.  A
    document and account listed twice count once, an account listed twice twice.
    """
    accounts = ocrd.where(F.col("u_accounttype") != EXCLUDED_ACCOUNT_TYPE).select(
        "cardcode", "groupcode", "address", "u_accounttype")
    by = ["cardcode"]
    if heads is not None:
        accounts = heads.select("docentry", "cardcode").repartition("cardcode").distinct().join(never_sent(accounts), "cardcode")
        by = ["docentry", "cardcode"]
    clinicians = odrs.select(F.col("dcode").alias("u_doctorcode"), "hosp")
    groups = special.select(F.col("imh_code").alias("itemcode"), "ti_test_grp")
    segment = F.when(
        F.col("groupcode") == 100,
        F.when(F.col("u_accounttype") == MISSION_ACCOUNT_TYPE, "Mission").otherwise("Regular Account"),
    ).otherwise(or_blank("hosp"))
    return (lines.join(never_sent(accounts), by).join(clinicians, "u_doctorcode", "left").join(never_sent(groups), "itemcode", "left")
            .select("docentry", "docdate", "labno", "itemcode", "whscode", "groupcode",
                    (or_zero("amount") - or_zero("adjamt")).alias("linetotal"), "paid", "u_doctorcode", "cardcode",
                    "address", "u_accounttype", segment.alias("hospital"),
                    F.coalesce("ti_test_grp", F.lit("REGULAR")).alias("ti_test_grp"), "linenum"))


#: A code with more tag intervals than this is matched month by month.
DENSE = 32
_ANY_MONTH = "1900-01-01"


def tag_months(tags: DataFrame, dense: DataFrame) -> DataFrame:
    """Tag intervals with ``_bin``: a row for each month an interval touches if its code is dense, else one row."""
    months = F.sequence(F.trunc("sdate", "MM").cast("date"), F.trunc("edate", "MM").cast("date"), F.expr("interval 1 month"))
    bins = F.when(F.col("_dense"), months).otherwise(F.array(day(_ANY_MONTH)))
    return tags.where("sdate <= edate").join(dense, ["stype", "bpcode"], "left").withColumn("_bin", F.explode(bins)).drop("_dense")


def tags_of_months(tags: DataFrame, months: DataFrame) -> DataFrame:
    """Tag intervals once for each month (stype, bpcode, ``_bin``) of ``months`` that they touch."""
    touched = F.col("_bin").between(F.trunc("sdate", "MM").cast("date"), F.trunc("edate", "MM").cast("date"))
    return tags.where("sdate <= edate").join(never_sent(months), ["stype", "bpcode"]).where(touched)


def asof_rep_assignment(lines: DataFrame, bpslp: DataFrame, dense: int = DENSE) -> DataFrame:
    """Add the rep tagged on the invoice date: by account for group 100, by clinician for 102.

    One interval join with an equality on (group, code, bin) serves both groups;
    lines of other groups have no rep rule and drop out.  A code with many
    intervals would meet every line with each of them, in one task: there the
    bin is the month of the invoice, and a line meets its month's intervals
    only.  Codes with more than ``dense`` intervals are found by a count and
    are few, so that Spark sends them to all tasks.  Group, code and bin are one
    key: a layout by the code alone would bring a hot code back into one task.
    The intervals are shuffled: they grow with accounts, and explodes hide how
    many there are, so that Spark would send far more to every task than it thinks.

    With ``dense`` below 1 every code goes by month.  Nothing has to tell codes
    apart then, but an open interval touches far more months than a code has
    lines in.  So the lines are written once, and only the months that a code
    has lines in are joined to its intervals.
    """
    code = F.when(F.col("groupcode") == 100, F.col("cardcode")).otherwise(F.col("u_doctorcode"))
    tags = bpslp.select("stype", "bpcode", "bpname", "slpcode", "sdate", "edate")
    lines, known = lines.where(F.col("groupcode").isin(100, 102)), tags.where("bpcode is not null")
    if dense < 1:
        lines = freeze(lines.select("groupcode", *[c for c in lines.columns if c != "groupcode"]), "lines_by_month")
        rows = lines.withColumn("_code", code).withColumn("_month", F.trunc("docdate", "MM").cast("date"))
        spans = tags_of_months(known, rows.select(F.col("groupcode").alias("stype"), F.col("_code").alias("bpcode"), F.col("_month").alias("_bin")).distinct())
    else:
        many = tags.groupBy("stype", "bpcode").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select(
            "stype", "bpcode", F.lit(True).alias("_dense"))
        wanted = many.select(F.col("stype").alias("groupcode"), F.col("bpcode").alias("_code"), "_dense")
        month = F.when(F.col("_dense"), F.trunc("docdate", "MM").cast("date")).otherwise(day(_ANY_MONTH))
        rows = lines.withColumn("_code", code).join(wanted, ["groupcode", "_code"], "left").withColumn("_month", month).drop("_dense")
        spans = tag_months(known, many)
    rows = rows.withColumn("_key", F.struct("groupcode", "_code", "_month"))
    spans = spans.withColumn("_tag", F.struct(F.col("stype").cast(lines.schema["groupcode"].dataType), "bpcode", "_bin"))
    match = (F.col("_key") == F.col("_tag")) & F.to_date("docdate").between(F.col("sdate"), F.col("edate"))
    return rows.join(never_sent(spans), match, "left").drop("stype", "sdate", "edate", "_bin", "_month", "_code", "_key", "_tag")


def incidental_zeroing(lines: DataFrame) -> DataFrame:
    """Incidental lines outside the special group earn nothing; ``lineamnt`` keeps the raw amount."""
    nothing = (F.col("hospital") == "INCIDENTAL") & (F.coalesce("ti_test_grp", F.lit("REGULAR")) != "SP")
    return lines.withColumns({
        "lineamnt": F.col("linetotal"),
        "linetotal": F.when(nothing, amount(F.lit(0))).otherwise(amount("linetotal")),
        "paid": F.when(nothing, amount(F.lit(0))).otherwise(amount("paid"))})


def commission_lines(t, frm=None, to=None, marks: DataFrame | None = None) -> DataFrame:
    """Commission detail rows of a period.  With ``marks``, lines flagged by an earlier run are skipped."""
    fact = invoice_line_fact(t.oinv, t.inv1, t.rin1, t.aopdet2, frm, to, marks=marks)
    # of a period, the credits leave the lines by case: there accounts meet the lines themselves
    rows = account_segment(fact, t.ocrd_ext, t.odrs, special_item_set(t.item_masterh), t.oinv if frm is None else None)
    return incidental_zeroing(asof_rep_assignment(rows, t.bpslp)).select(
        "docentry", "docdate", "labno", "linenum", "itemcode", "whscode", "slpcode", "groupcode", "bpcode", "bpname",
        "hospital", "lineamnt", "linetotal", "paid", "ti_test_grp")


class CommissionRun(NamedTuple):
    header: DataFrame
    details: DataFrame
    marks: DataFrame


def commission_generation(t, gen_id: int, frm, to, user: str, as_of, marks: DataFrame | None = None) -> CommissionRun:
    """One run: its header row, its unprocessed details and the source lines they flag."""
    details = commission_lines(t, frm, to, marks).drop("lineamnt").select(
        "*", F.lit(0).alias("isprocess"), day(as_of).alias("recdate"), F.lit(gen_id).cast("int").alias("genid"))
    header = details.sparkSession.range(1).select(
        F.lit(gen_id).cast("int").alias("genid"), day(frm).alias("datefrom"), day(to).alias("dateto"),
        F.lit(user).alias("createdby"), day(as_of).alias("createddate"))
    return CommissionRun(header, details, details.select("docentry", "linenum", "itemcode").distinct())


def _by_rep_month(detail: DataFrame, keep_run: bool) -> DataFrame:
    """Sums per rep, segment type and month (and run); lines without a segment drop out."""
    kind = F.when(F.upper("hospital") == "MISSION", "Mission").otherwise("Regular").alias("type")
    keys = ["slpcode", kind, F.month("docdate").alias("pd"), F.year("docdate").alias("yr"),
            month_start(F.col("docdate")).alias("transmonth")]
    if keep_run:
        keys.append("genid")
    return detail.where("hospital is not null").groupBy(*keys).agg(
        total("linetotal").alias("totalamount"), total("paid").alias("paid"))


def _with_measures(rows: DataFrame, qualifiers: DataFrame, reps: DataFrame, targets: DataFrame,
                   rep_for_qualifiers) -> DataFrame:
    q = qualifiers.select(F.col("slpcode").alias("q_rep"), F.col("month").alias("q_m"), F.col("year").alias("q_y"),
                          "salesqualifier", "callsqualifier", "callsperformance")
    g = targets.select(F.col("slpcode").alias("t_rep"), F.col("pd").alias("t_m"), F.col("yr").alias("t_y"), "amt")
    r = reps.select(F.col("slpcode").alias("r_rep"), "slpname")
    known = F.coalesce(F.col("slpcode"), F.lit(NO_REP))
    return (rows.join(q, (F.col("q_rep") == rep_for_qualifiers) & (F.col("q_m") == F.col("pd"))
                      & (F.col("q_y") == F.col("yr")), "left")
            .join(r, F.col("r_rep") == rep_for_qualifiers, "left")
            .join(g, (F.col("t_rep") == known) & (F.col("t_m") == F.col("pd")) & (F.col("t_y") == F.col("yr")), "left")
            .withColumns({"slpcode": known, "slpname": F.coalesce("slpname", F.lit(NO_REP_NAME))}))


def _run_filter(detail: DataFrame, gen_id: int | None) -> DataFrame:
    """Run 0 means everything unprocessed; a run, or no run, means processed rows."""
    if gen_id == 0:
        return detail.where("isprocess = 0")
    done = detail.where("isprocess = 1")
    return done if gen_id is None else done.where(F.col("genid") == gen_id)


def commission_summary(detail: DataFrame, qualifiers: DataFrame, reps: DataFrame, targets: DataFrame,
                       gen_id: int | None = 0) -> DataFrame:
    """Totals per rep and per distinct qualifier and target values (not per month)."""
    months = _by_rep_month(_run_filter(detail, gen_id), keep_run=False)
    rows = _with_measures(months, qualifiers, reps, targets, F.coalesce(F.col("slpcode"), F.lit(NO_REP)))
    sums = rows.groupBy("slpcode", "slpname", "salesqualifier", "callsqualifier", "callsperformance", "amt").agg(
        total("totalamount").alias("totalamount"), total("paid").alias("paid"))
    return sums.select("slpcode", "slpname", "totalamount", "paid", or_zero("salesqualifier").alias("salesqualifier"),
                       or_zero("callsqualifier").alias("callsqualifier"),
                       or_zero("callsperformance").alias("callsperformance"), or_zero("amt").alias("targetsales"))


def commission_detail(detail: DataFrame, qualifiers: DataFrame, reps: DataFrame, targets: DataFrame,
                      rep_list=None, gen_id: int | None = 0, is_process: int | None = None,
                      keep_run: bool = False) -> DataFrame:
    """Totals per rep, segment type and month.

    ``gen_id`` selects as in the summary.  With ``is_process`` the processing
    state selects instead, and the run may be kept (``keep_run``).
    """
    rows = _run_filter(detail, gen_id) if is_process is None else detail.where(F.col("isprocess") == is_process)
    if rep_list is not None:
        rows = rows.where(F.col("slpcode").isin([str(r) for r in rep_list]))
    months = _by_rep_month(rows, keep_run)
    out = _with_measures(months, qualifiers, reps, targets, F.col("slpcode"))
    when = F.col("transmonth") if keep_run else month_label(F.col("transmonth"))
    columns = ["slpcode", "slpname", or_zero("totalamount").alias("totalamount"), or_zero("paid").alias("paid"),
               "type", when.alias("transdate")]
    measures = [or_zero("salesqualifier").alias("salesqualifier"), or_zero("callsqualifier").alias("callsqualifier"),
                or_zero("callsperformance").alias("callsperformance"), or_zero("amt").alias("targetsales")]
    return out.select(*columns, *(["genid"] if keep_run else []), *measures)


def commission_worklist(detail: DataFrame, qualifiers: DataFrame, reps: DataFrame, targets: DataFrame,
                        is_process: int = 0, rep_list=None) -> DataFrame:
    """Gross and paid sales per rep, month and run, with the measures of the month."""
    rows = commission_detail(detail, qualifiers, reps, targets, rep_list, is_process=is_process, keep_run=True)
    return rows.groupBy("slpcode", "slpname", "transdate", "salesqualifier", "callsqualifier", "callsperformance",
                        "targetsales", "genid").agg(
        total("totalamount").alias("grossamnt"), total("paid").alias("paidamnt"))


def scheme_asof(scheme_hdr: DataFrame, scheme_dtl: DataFrame, dates: DataFrame) -> DataFrame:
    """Scheme lines valid on each date of ``dates`` (column ``docdate``), mission lines last.

    A scheme's validity is spread over the years it touches, so dates meet it
    by an equality and only then by the interval.
    """
    wanted = dates.select("docdate").distinct().withColumn("_y", F.year("docdate"))
    last = wanted.agg(F.max("_y")).scalar()
    spans = scheme_hdr.select("schemecode", "datestarted", F.coalesce("dateended", day(OPEN_END)).alias("dateended"))
    spans = spans.withColumn("_to", F.least(F.year("dateended"), last)).where(F.year("datestarted") <= F.col("_to"))
    spans = spans.withColumn("_y", F.explode(F.sequence(F.year("datestarted"), F.col("_to")))).drop("_to")
    valid = wanted.join(spans, "_y").where(F.col("docdate").between(F.col("datestarted"), F.col("dateended")))
    return (valid.join(scheme_dtl.where("isdeleted = 0"), "schemecode")
            .orderBy("docdate", F.when(F.col("commtype") != "MISSION", 1).otherwise(2), "orderby")
            .select("docdate", "schemecode", amount("amtfr").alias("amtfr"), amount("amtto").alias("amtto"),
                    amount("prcnt").alias("prcnt"), "commtype", "datestarted", "dateended"))


class Payout(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    processed: DataFrame


def commission_payout(headers: DataFrame, lines: DataFrame) -> Payout:
    """Gross and net commission for a batch of headers (genid, slpcode, …) and their scheme lines."""
    keys = ["genid", "slpcode"]
    gross = lines.groupBy(*keys).agg(total(or_zero("commission")).alias("commgross"))
    paid = headers.drop("commgross", "commnet").join(gross, keys, "left")
    percent = amount(F.col("salesnetpercentage") + F.col("callsnetpercentage"))
    return Payout(paid.withColumn("commnet", percent_of(F.col("commgross"), percent)),
                  lines.join(headers.select(*keys), keys, "left_semi"), headers.select(*keys).distinct())


def mark_processed(detail: DataFrame, processed: DataFrame) -> DataFrame:
    """Commission details with ``isprocess`` = 1 where their (run, rep) was paid."""
    hit = processed.select("genid", "slpcode", F.lit(1).alias("_hit")).distinct()
    rows = detail.join(hit, ["genid", "slpcode"], "left")
    return rows.withColumn("isprocess", F.coalesce("_hit", "isprocess")).drop("_hit")


def _each_period(rows: DataFrame, calendar: DataFrame, year=None, month=None) -> DataFrame:
    """Rows × the distinct periods of a calendar."""
    return product(rows, optional(calendar, yr=year, pd=month or None).select("yr", "pd"))


def sales_target_grid(reps: DataFrame, calendar: DataFrame, targets: DataFrame, year=None, month=None,
                      rep=None) -> DataFrame:
    """Every rep and period with the target, 0 where none was set."""
    who = optional(reps.select("slpcode", "slpname", "district"), slpcode=rep)
    grid = _each_period(who, calendar, year, month)
    return grid.join(targets.select("slpcode", "yr", "pd", "amt"), ["slpcode", "yr", "pd"], "left").select(
        "slpcode", "slpname", F.coalesce("district", F.lit("NO DISTRICT")).alias("district"), "yr", "pd",
        or_zero("amt").alias("amt"), F.make_date("yr", "pd", F.lit(1)).alias("dateset"))


def qualifier_grid(reps: DataFrame, calendar: DataFrame, qualifiers: DataFrame, rep=None, year=None,
                   month=None) -> DataFrame:
    """Every rep and period with the three qualifier measures, 0 where none was set."""
    who = optional(reps.select("slpcode", "slpname"), slpcode=rep)
    grid = _each_period(who, calendar, year, month)
    measures = qualifiers.select("slpcode", F.col("year").alias("yr"), F.col("month").alias("pd"), "salesqualifier",
                                 "callsqualifier", "callsperformance")
    return grid.join(measures, ["slpcode", "yr", "pd"], "left").select(
        "slpcode", "slpname", *[or_zero(c).alias(c) for c in
                                ("salesqualifier", "callsqualifier", "callsperformance")], "pd", "yr")


def rep_roster(reps_ext: DataFrame, reps: DataFrame, employees: DataFrame, as_of, rep=None) -> DataFrame:
    """Reps known in both masters, with tenure counted in calendar years."""
    who = optional(reps.where("slpcode <> '-1'"), slpcode=rep)
    hired = employees.select(F.col("empcode").alias("empid"), "datehired")
    unset = F.lit("NOT SET")
    return (who.join(reps_ext.select("slpcode"), "slpcode").join(hired, "empid", "left").select(
        "slpcode", "slpname", F.coalesce("district", unset).alias("district"),
        F.coalesce("position", unset).alias("position"), F.coalesce("email", unset).alias("email"),
        or_zero("incentive").alias("incentive"), or_blank("comtype").alias("comtype"), or_blank("atm").alias("atm"),
        or_blank("whscode").alias("whscode"), F.col("datehired").alias("datestarted"),
        F.coalesce(years_apart(F.col("datehired"), day(as_of)), F.lit(0)).alias("noofyrs"),
        or_zero("salesqualifier").alias("salesqualifier"), or_zero("callsqualifier").alias("callsqualifier"),
        or_blank("empid").alias("empid")))


def unassigned_employees(employees: DataFrame, reps: DataFrame, as_of, dept: int = SALES_DEPARTMENT,
                         employee=None) -> DataFrame:
    """Employees of the sales department no rep record refers to; a missing name part blanks the name."""
    taken = reps.where(~is_blank("empid")).select(F.col("empid").alias("empcode"))
    free = optional(employees.where(F.col("deptcode") == dept), empcode=employee).join(taken, "empcode", "left_anti")
    name = F.concat(F.upper("fname"), F.lit(" "), F.upper("mname"), F.lit(" "), F.upper("lname"))
    return free.select("empcode", name.alias("empname"), "branchcode", F.col("datehired").alias("datestarted"),
                       F.coalesce(years_apart(F.col("datehired"), day(as_of)), F.lit(0)).alias("noofyrs"))
