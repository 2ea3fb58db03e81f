"""Budget and payment-gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget as b
from ..operators.banding import budget_gate
from .registry import register
from .results_sql import D2, ages, pct, ratio, sum2, zero

AS_OF = "2001-08-31"


def core(t):
    return t.rbdets, t.rb_payees, t.rac_budgetcriteria


def _rows(where: str = "true", kind: str | None = None) -> str:
    join = f"join fx_payees p on p.pid = d.u_paycode and p.actype = '{kind}'" if kind else "left join fx_payees p on p.pid = d.u_paycode"
    return f"""(select d.*, p.actype, p.slpcode, date_diff('day', d.recondate, date '{AS_OF}') ndys from st_rbdets d {join}
        where coalesce(d.comtype, '') <> '' and {where})"""


def _gate(rows: str, keys: str, passed: int = 1, failed: int = 0) -> str:
    cols = ", ".join("g." + k.strip() for k in keys.split(","))
    return f"""(select {cols}, g.rebate, {zero('c.amntexcluded')} amntexcluded,
        case when g.rebate > coalesce(c.amntexcluded, 0) then {passed} else {failed} end budgetstat
        from (select {keys}, {sum2('rebate')} rebate from {rows} group by {keys}) g
        left join fx_criteria c on c.whscode = g.whscode and c.accounttype = g.actype)"""


_OPEN = "d.isforpaymnt = 0"
_BY_BRANCH = "u_paycode, whscode, actype"
_DOC = "docentry, u_paycode, u_labno, cardcode, whscode, u_doctorcode, groupcode"

register("budget_gate",
         lambda t: budget_gate(b.rated_rows(t.rbdets, t.rb_payees), t.rac_budgetcriteria, ["genid", "u_paycode", "whscode", "actype"]),
         f"select * from {_gate(_rows(), 'genid, u_paycode, whscode, actype')}")


def pivot(t):
    rows = b.rated_rows(t.rbdets, t.rb_payees, AS_OF)
    return b.aging_bucket_pivot(rows, "ndys", "rebate", ["u_paycode", "whscode"]).selectExpr(
        "u_paycode", "whscode", *[f"coalesce({c}, 0.00) as {c.lower()}" for c in b.AGE_LABELS])


register("aging_bucket_pivot", pivot,
         f"select u_paycode, whscode, {ages('ndys', 'rebate')} from {_rows()} where ndys >= 0 group by 1, 2")
for _kind in ("CLINICIAN", "ACCOUNT"):
    register("payment_candidates" if _kind == "CLINICIAN" else "payment_candidates_accounts",
             lambda t, kind=_kind: b.payment_candidates(*core(t), t.oslp, AS_OF, kind, "All", None, None, "1000.00"),
             f"""select g.u_paycode paycode, coalesce(p.pname, 'NO SETUP') payname, g.budget, {', '.join(zero('a.' + c) + ' ' + c for c in ('d01_30', 'd31_60', 'd61_90', 'd91_120', 'over120'))},
             coalesce(p.add1, '') add1, coalesce(o.slpname, '') slpname, coalesce(p.acctnum, '') acctnum, coalesce(p.telno, '') telno, o.slpcode,
             g.actype, g.isforpaymnt
             from (select u_paycode, actype, isforpaymnt, {sum2('rebate')} budget from {_gate(_rows(_OPEN, _kind), _BY_BRANCH + ', isforpaymnt')}
                 where budgetstat = 1 group by 1, 2, 3) g
             left join (select u_paycode, {ages('ndys', 'rebate')} from {_rows(_OPEN, _kind)} where ndys >= 0 group by 1) a on a.u_paycode = g.u_paycode
             left join fx_payees p on p.pid = g.u_paycode left join fx_oslp o on o.slpcode = p.slpcode where g.budget > 1000""")
register("payment_detail_lines", lambda t: b.payment_detail_lines(*core(t), AS_OF),
         f"""select {_DOC}, ndys, budgetstat, isexcluded, {sum2('rebate')} rebate
         from {_gate(_rows(), _DOC + ', actype, ndys, isexcluded', 0, 1)} group by all""")
register("payee_branch_gate", lambda t: b.payee_branch_gate(*core(t), "CLINICIAN", None, None, None),
         f"select * from {_gate(_rows(_OPEN, 'CLINICIAN'), _BY_BRANCH)}")
_PAYABLE = f"""(select * from {_gate(_rows(), _DOC + ', actype, ndys, isexcluded, slpcode, genid')} where budgetstat = 1 and isexcluded = 0)"""
register("payment_header", lambda t: b.payment_header(*core(t), t.soadate, AS_OF),
         f"""select d.u_paycode, {sum2('d.rebate')} payment, date '{AS_OF}' recdate, r.fdate trandate, d.slpcode, 3 stat from {_PAYABLE} d
         left join fx_soadate r on r.genid = d.genid group by d.u_paycode, d.slpcode, r.fdate""")
register("payment_lines", lambda t: b.payment_lines(*core(t), AS_OF),
         f"select u_paycode, whscode, {sum2('rebate')} rebate from {_PAYABLE} group by 1, 2")


def created(t):
    """The budget of every run, against everything unpaid up to it."""
    return b.branch_budgets(t.jdt1, t.ojdt, t.oact, *core(t), t.soadate)


def created_for_last(t):
    """The same for the last run alone, as one run makes it."""
    last = t.soadate.agg(F.max("genid").alias("g")).scalar()
    return b.branch_budget_create(t.jdt1, t.ojdt, t.oact, *core(t), t.soadate, last, 0)


_SOLD = f"""(select r.genid, a.segment_1, cast(cast(sum(j.credit) as {D2}) - cast(sum(j.debit) as {D2}) as decimal(28,2)) sales from fx_jdt1 j
    join fx_oact a on a.acctcode = j.account join fx_ojdt t on t.transid = j.transid join fx_soadate r on t.refdate between r.fdate and r.tdate
    where a.segment_0 = '40100' group by 1, 2)"""
_UP_TO = f"(select r.genid run, d.* exclude (genid) from fx_soadate r join {_rows(_OPEN)} d on d.genid <= r.genid)"
_GATED = _gate(_UP_TO, "run, " + _BY_BRANCH)
_BUDGET = f"""select s.genid, s.segment_1 whscode, s.sales, cast(2 as {D2}) percnt, cast({pct('s.sales', '2')} as decimal(28,2)) budgetamt,
         {zero('g.v')} rebates from {_SOLD} s left join (select run, whscode, {sum2('rebate')} v from {_GATED} where budgetstat = 1 group by 1, 2) g
         on g.whscode = s.segment_1 and g.run = s.genid"""
register("branch_budget_create", lambda t: created(t).lines, _BUDGET)
register("branch_budget_create_header", lambda t: created(t).header,
         f"""select r.genid, r.fdate startdate, r.tdate enddate, s.v totalsales, {zero('g.v')} totalrebate from fx_soadate r
         left join (select genid, cast(sum(sales) as decimal(28,2)) v from {_SOLD} group by 1) s on s.genid = r.genid
         left join (select run, {sum2('rebate')} v from {_GATED} group by 1) g on g.run = r.genid""")
register("branch_budget_create_one_run", lambda t: created_for_last(t).lines,
         f"select * from ({_BUDGET}) where genid = (select max(genid) from fx_soadate)")
register("budget_summary", lambda t: b.budget_summary(t.rac_rebbudgethdr, t.rac_rebbudgetdtl),
         f"""select genid, startdate, enddate, cast(s as decimal(28,2)) totalsales, cast(b as decimal(28,2)) totalbudget, cast(r as decimal(28,2)) totalrebate,
         cast(b - r as decimal(28,2)) totalexcess, {ratio('r', 's')} totalprcnttosales from (select h.genid, h.startdate, h.enddate,
         {sum2('coalesce(d.sales, 0)')} s, {sum2('coalesce(d.budgetamt, 0)')} b, {sum2('coalesce(d.rebates, 0)')} r from st_budgethdr h
         join st_budgetdtl d on d.genid = h.genid group by 1, 2, 3)""")
register("branch_budget_detail", lambda t: b.branch_budget_detail(t.rac_rebbudgetdtl, t.sapset),
         f"""select d.whscode branchcode, s.blk branchname, d.sales, {zero('d.percnt')} percnt, {zero('d.budgetamt')} budgamt, {zero('d.rebates')} rebates,
         cast(coalesce(d.budgetamt, 0) - coalesce(d.rebates, 0) as {D2}) excess, {ratio('coalesce(d.rebates, 0)', 'd.sales')} percntofactsales, d.genid
         from st_budgetdtl d left join fx_sapset s on s.code = d.whscode""")


def percentages(t):
    """New percentages for the open branches of every run: 1.5 % plus a quarter per branch digit."""
    return t.rac_rebbudgetdtl.selectExpr("genid", "whscode", "cast(1.5 + 0.25 * (cast(whscode as int) % 10) as decimal(18,2)) as percnt").where(
        "whscode not in ('009', '019')")


_NEWPCT = "cast(1.5 + 0.25 * (cast(whscode as int) % 10) as decimal(18,2))"
register("budget_repercent", lambda t: b.budget_repercent(t.rac_rebbudgetdtl, percentages(t)),
         f"""select genid, whscode, sales, case when whscode in ('009', '019') then percnt else {_NEWPCT} end percnt,
         case when whscode in ('009', '019') then budgetamt else {pct('sales', _NEWPCT)} end budgetamt, rebates from st_budgetdtl""")
register("budget_repercent_hierarchy",
         lambda t: b.hierarchy_repercent(t.rac_budgethierarchy, t.rac_budgethierarchy.where("whscode <> '019'").selectExpr(
             "genid", "whscode", "cast(1.5 + 0.25 * (cast(whscode as int) % 10) as decimal(18,2)) as prcent")),
         f"""select genid, whscode, sales, case when whscode = '019' then prcent else {_NEWPCT} end prcent,
         case when whscode = '019' then budgetamnt else {pct('sales', _NEWPCT)} end budgetamnt, rebates,
         case when whscode = '019' then excesstobudget else cast(case when {pct('sales', _NEWPCT)} - rebates >= 0 then 0
         else abs({pct('sales', _NEWPCT)} - rebates) end as {D2}) end excesstobudget, prcnttosales from st_hier""")
register("budget_remaining", lambda t: b.budget_remaining(t.rbdets, t.rb_payees, t.rac_rebbudgetdtl, "CLINICIAN"),
         f"""select b.s totsales, cast(b.b - coalesce(p.v, 0) as {D2}) totbudget, b.genid from (select genid, {zero(sum2('sales'))} s, {zero(sum2('budgetamt'))} b
         from st_budgetdtl group by 1) b left join (select genid, {sum2('rebate')} v from {_rows('d.isforpaymnt = 1', 'CLINICIAN')} group by 1) p
         on p.genid = b.genid""")
register("budget_hierarchy", lambda t: b.budget_hierarchy(t.sales, t.rbdets, t.sapset), "select * from st_hier_all")
register("budget_hierarchy_list", lambda t: b.budget_hierarchy_list(t.rac_budgethierarchy, t.sapset),
         f"""select h.whscode, s.whsname, h.prcent, h.genid, {', '.join(zero('h.' + c) + ' ' + c for c in ('sales', 'budgetamnt', 'rebates', 'excesstobudget', 'prcnttosales'))}
         from st_hier h left join fx_sapset s on s.code = h.whscode""")
register("budget_criteria_fill", lambda t: b.budget_criteria_fill(t.rac_budgetcriteria, t.sapset, ["CLINICIAN", "ACCOUNT", "FUND"], 750),
         f"""select a accounttype, s.code whscode, cast(750 as {D2}) amntexcluded from fx_sapset s, (select unnest(['CLINICIAN', 'ACCOUNT', 'FUND']) a)
         where s.stat = 'O' and not exists (select 1 from fx_criteria c where c.accounttype = a and c.whscode = s.code)""")
register("budget_criteria_list", lambda t: b.budget_criteria_list(t.rac_budgetcriteria, t.sapset),
         "select c.accounttype, c.whscode, s.whsname, c.amntexcluded from fx_criteria c left join fx_sapset s on s.code = c.whscode")
