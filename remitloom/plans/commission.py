"""Commission queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import percent_of, total
from ..operators import commission as c
from .registry import register
from .results_sql import pct, sum2, zero

FACT = [*c.FACT_KEYS, "amount", "adjamt", "paid"]
AS_OF = "2024-06-30"


def fact(t):
    return c.invoice_line_fact(t.oinv, t.inv1, t.rin1, t.aopdet2)


def segments(t):
    return c.account_segment(fact(t), t.ocrd_ext, t.odrs, c.special_item_set(t.item_masterh))


def tagged(t):
    return c.asof_rep_assignment(segments(t), t.bpslp)


register("invoice_line_fact", lambda t: fact(t).select(*FACT), f"select {', '.join(FACT)} from st_fact")
register("special_item_set", lambda t: c.special_item_set(t.item_masterh), "select * from st_spitem")
register("account_segment", segments, "select * from st_segment")
register("asof_rep_assignment", tagged, "select * from st_tagged")
register("asof_rep_assignment_by_month", lambda t: c.asof_rep_assignment(segments(t), t.bpslp, dense=0), "select * from st_tagged")
register("incidental_zeroing",
         lambda t: c.incidental_zeroing(segments(t)).select("docentry", "linenum", "hospital", "ti_test_grp", "lineamnt", "linetotal", "paid"),
         """select docentry, linenum, hospital, ti_test_grp, cast(linetotal as decimal(18,2)) lineamnt,
         cast(case when hospital = 'INCIDENTAL' and ti_test_grp <> 'SP' then 0 else linetotal end as decimal(18,2)) linetotal,
         cast(case when hospital = 'INCIDENTAL' and ti_test_grp <> 'SP' then 0 else paid end as decimal(18,2)) paid from st_segment""")
_COMM = ["docentry", "docdate", "labno", "linenum", "itemcode", "whscode", "slpcode", "groupcode", "bpcode", "bpname",
         "hospital", "linetotal", "paid", "ti_test_grp"]


def one_run(t):
    """A run over the whole span of the invoices."""
    first, last = (t.oinv.agg(end("docdate").alias("d")).scalar() for end in (F.min, F.max))
    return c.commission_generation(t, 7, first, last, "u1", AS_OF)


register("commission_generation", lambda t: one_run(t).details.select(*_COMM, "isprocess", "genid"),
         f"select {', '.join(_COMM)}, 0 isprocess, 7 genid from st_commline")
register("commission_generation_marks",
         lambda t: one_run(t).marks,
         "select distinct docentry, linenum, itemcode from st_commline")
register("commission_generation_header", lambda t: one_run(t).header,
         f"select 7 genid, min(docdate) datefrom, max(docdate) dateto, 'u1' createdby, date '{AS_OF}' createddate from fx_oinv")
register("commission_generation_skip_marked",
         lambda t: c.commission_lines(t, marks=t.rac_commcomputationdtl.where("genid <= 3")).select(*_COMM),
         f"""select {', '.join('l.' + x for x in _COMM)} from st_commline l
         where not exists (select 1 from st_comm m where m.genid <= 3 and m.docentry = l.docentry and m.linenum = l.linenum and m.itemcode = l.itemcode)""")


def _months(where: str, run: str = "") -> str:
    return f"""(select slpcode, case when hospital = 'Mission' then 'Mission' else 'Regular' end as type, month(docdate) pd, year(docdate) yr,
        cast(date_trunc('month', docdate) as date) md{run}, {sum2('linetotal')} totalamount, {sum2('paid')} paid from st_comm
        where hospital is not null and {where} group by 1, 2, 3, 4, 5{', 6' if run else ''})"""


def _measured(months: str, rep: str) -> str:
    return f"""{months} t left join fx_qualifiers q on q.slpcode = {rep} and q.mm = t.pd and q.yy = t.yr
        left join fx_oslp o on o.slpcode = {rep}
        left join fx_targets g on g.slpcode = coalesce(t.slpcode, '-1') and g.pd = t.pd and g.yr = t.yr"""


_MEASURES = f"""{zero('q.salesqualifier')} salesqualifier, {zero('q.callsqualifier')} callsqualifier,
    {zero('q.callsperformance')} callsperformance, {zero('g.amt')} targetsales"""
_WHO = "coalesce(t.slpcode, '-1') slpcode, coalesce(o.slpname, '-No Sales Employee-') slpname"


def _summary(where: str) -> str:
    return f"""select {_WHO}, {sum2('t.totalamount')} totalamount, {sum2('t.paid')} paid, {_MEASURES}
        from {_measured(_months(where), "coalesce(t.slpcode, '-1')")}
        group by coalesce(t.slpcode, '-1'), coalesce(o.slpname, '-No Sales Employee-'), q.salesqualifier, q.callsqualifier, q.callsperformance, g.amt"""


def inputs(t):
    return t.rac_commcomputationdtl, t.rac_commqualifiers, t.oslp, t.comtargetdtl


register("commission_summary", lambda t: c.commission_summary(*inputs(t), gen_id=0), _summary("isprocess = 0"))
register("commission_summary_processed", lambda t: c.commission_summary(*inputs(t), gen_id=None), _summary("isprocess = 1"))
register("commission_detail", lambda t: c.commission_detail(*inputs(t), gen_id=0),
         f"""select {_WHO}, {zero('t.totalamount')} totalamount, {zero('t.paid')} paid, t.type, strftime(t.md, '%B %Y') transdate, {_MEASURES}
         from {_measured(_months('isprocess = 0'), 't.slpcode')}""")
register("commission_detail_by_run", lambda t: c.commission_detail(*inputs(t), is_process=1, keep_run=True),
         f"""select {_WHO}, {zero('t.totalamount')} totalamount, {zero('t.paid')} paid, t.type, t.md transdate, t.genid, {_MEASURES}
         from {_measured(_months('isprocess = 1', ', genid'), 't.slpcode')}""")
register("commission_worklist", lambda t: c.commission_worklist(*inputs(t), is_process=0),
         f"""select slpcode, slpname, transdate, salesqualifier, callsqualifier, callsperformance, targetsales, genid,
         {sum2('totalamount')} grossamnt, {sum2('paid')} paidamnt from (select {_WHO}, t.totalamount, t.paid, t.md transdate, t.genid, {_MEASURES}
         from {_measured(_months('isprocess = 0', ', genid'), 't.slpcode')}) group by all""")
register("scheme_asof", lambda t: c.scheme_asof(t.commschemehdr, t.commschemedtl, t.oinv.select("docdate")),
         """select d.docdate, x.schemecode, x.amtfr, x.amtto, x.prcnt, x.commtype, h.datestarted,
         coalesce(h.dateended, date '2099-12-31') dateended from (select distinct docdate from fx_oinv) d
         join fx_commhdr h on d.docdate between h.datestarted and coalesce(h.dateended, date '2099-12-31')
         join fx_commdtl x on x.schemecode = h.schemecode where x.isdeleted = 0""")


def paid_batch(t):
    """A batch of payouts per (run, rep): headers with percentages, one scheme line per segment type."""
    rows = t.rac_commcomputationdtl.where("isprocess = 0 and slpcode is not null")
    lines = rows.groupBy("genid", "slpcode", F.when(F.col("hospital") == "Mission", "MISSION").otherwise("REGULAR").alias("schemetype")).agg(
        total("linetotal").alias("schemesales"), total("paid").alias("sales"))
    lines = lines.withColumn("commission", percent_of(F.col("schemesales"), F.lit(3)))
    heads = rows.groupBy("genid", "slpcode").agg(total("linetotal").alias("grosssales"), total("paid").alias("paidsales"))
    heads = heads.selectExpr("*", "cast(40 + cast(slpcode as int) % 7 as decimal(18,2)) as salesnetpercentage",
                             "cast(30.25 as decimal(18,2)) as callsnetpercentage")
    return heads, lines


_LINES = f"""(select genid, slpcode, case when hospital = 'Mission' then 'MISSION' else 'REGULAR' end schemetype,
    {pct(sum2('linetotal'), '3')} commission from st_comm where isprocess = 0 and slpcode is not null group by 1, 2, 3)"""
_GROSS = f"(select genid, slpcode, {sum2('commission')} commgross from {_LINES} group by 1, 2)"
_PERCENT = "(cast(40 + cast(g.slpcode as int) % 7 as decimal(18,2)) + 30.25)"
register("commission_payout", lambda t: c.commission_payout(*paid_batch(t)).headers,
         f"""select h.*, g.commgross, {pct('g.commgross', _PERCENT)} commnet from (select genid, slpcode, {sum2('linetotal')} grosssales,
         {sum2('paid')} paidsales, cast(40 + cast(slpcode as int) % 7 as decimal(18,2)) salesnetpercentage,
         cast(30.25 as decimal(18,2)) callsnetpercentage from st_comm where isprocess = 0 and slpcode is not null group by 1, 2) h
         join {_GROSS} g on g.genid = h.genid and g.slpcode = h.slpcode""")
register("commission_payout_processed",
         lambda t: c.mark_processed(t.rac_commcomputationdtl, c.commission_payout(*paid_batch(t)).processed).select(
             "docentry", "linenum", "slpcode", "genid", "isprocess"),
         """select docentry, linenum, slpcode, genid, case when isprocess = 0 and slpcode is not null then 1 else isprocess end isprocess
         from st_comm""")
register("sales_target_grid", lambda t: c.sales_target_grid(t.oslp, t.calendar, t.comtargetdtl),
         f"""select o.slpcode, o.slpname, coalesce(o.district, 'NO DISTRICT') district, k.yr, k.pd, {zero('g.amt')} amt,
         make_date(k.yr, k.pd, 1) dateset from fx_oslp o, (select distinct yr, pd from fx_calendar) k
         left join fx_targets g on g.slpcode = o.slpcode and g.yr = k.yr and g.pd = k.pd""")
register("qualifier_grid", lambda t: c.qualifier_grid(t.oslp, t.calendar, t.rac_commqualifiers),
         f"""select o.slpcode, o.slpname, {zero('q.salesqualifier')} salesqualifier, {zero('q.callsqualifier')} callsqualifier,
         {zero('q.callsperformance')} callsperformance, k.pd, k.yr from fx_oslp o, (select distinct yr, pd from fx_calendar) k
         left join fx_qualifiers q on q.slpcode = o.slpcode and q.yy = k.yr and q.mm = k.pd""")
register("rep_roster", lambda t: c.rep_roster(t.oslp_ext, t.oslp, t.scempnew, AS_OF),
         """select o.slpcode, o.slpname, coalesce(district, 'NOT SET') district, coalesce(position, 'NOT SET') "position",
         coalesce(email, 'NOT SET') email, incentive, coalesce(comtype, '') comtype, coalesce(atm, '') atm, whscode, e.datehired datestarted,
         coalesce(2024 - year(e.datehired), 0) noofyrs, salesqualifier, callsqualifier, coalesce(empid, '') empid
         from fx_oslp o join fx_oslp_ext x on x.slpcode = o.slpcode left join fx_emp e on e.empcode = o.empid where o.slpcode <> '-1'""")
register("unassigned_employees", lambda t: c.unassigned_employees(t.scempnew, t.oslp, AS_OF),
         """select e.empcode, upper(fname) || ' ' || upper(mname) || ' ' || upper(lname) empname, branchcode, datehired datestarted,
         coalesce(2024 - year(datehired), 0) noofyrs from fx_emp e left join fx_oslp o on o.empid = e.empcode
         where deptcode = 18 and coalesce(o.empid, '') = ''""")
