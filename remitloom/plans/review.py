"""Review, posting and run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed as k
from ..operators import review as r
from .registry import register
from .results_sql import banding, sum2, zero

AS_OF = "2002-01-31"
_TOTALS = "(select genid, u_paycode, whscode, isforpayment, " + sum2("rebatesamnt") + " rebatesamnt from st_detail group by 1, 2, 3, 4)"
_STATES = "(select genid, u_paycode, whscode, isforpayment, stat, " + sum2("rebatesamnt") + " rebatesamnt from st_detail group by 1, 2, 3, 4, 5)"

register("rebates_by_branch",
         lambda t: r.rebates_by_branch(t.rac_rbdetailstrans, t.rac_rbpayments, t.rac_rbaginghistory, t.rb_payees, t.rac_payeescheme,
                                       t.rac_maintenancecode, t.rac_budgethierarchy, t.sapset),
         f"""select d.genid, d.whscode, b.whsname, {zero('h.sales')} sales, {zero('h.budgetamnt')} budgetamnt, d.rebatesamnt,
         {zero('c.v')} computedreb, {zero('p.v')} totactualreb, {zero('a.v')} totagingreb,
         {zero('case when h.budgetamnt - (coalesce(p.v, 0) + coalesce(a.v, 0)) >= 0 then 0 else abs(h.budgetamnt - (coalesce(p.v, 0) + coalesce(a.v, 0))) end')} excess
         from (select genid, whscode, {sum2('rebatesamnt')} rebatesamnt from st_detail group by 1, 2) d
         left join st_hier h on h.genid = d.genid and h.whscode = d.whscode left join fx_sapset b on b.code = d.whscode
         left join (select genid, whscode, {sum2('actualreb')} v from ({banding(_TOTALS, ['genid', 'u_paycode', 'isforpayment'])}) where isforpayment = 1 group by 1, 2) c
         on c.genid = d.genid and c.whscode = d.whscode
         left join (select genid, whscode, {sum2('amountpaid')} v from fx_history group by 1, 2) a on a.genid = d.genid and a.whscode = d.whscode
         left join (select genid, whscode, {sum2('actualrebates')} v from fx_payments group by 1, 2) p on p.genid = d.genid and p.whscode = d.whscode""")

_REVIEWED = f"""(select coalesce(x.stat, 0) status, x.genid, x.u_paycode, x.pname, x.add1, x."class", x.actype, x.periodtype,
    coalesce(x.slpcode, '') slpcode, coalesce(o.slpname, '') slpname, x.whscode, x.rebatesamnt, x.percnt, x.amntexclusion, x.actualreb,
    {zero('a.v')} agingreb, x.isforpayment from ({banding(_STATES, ['genid', 'u_paycode', 'isforpayment', 'stat'])}) x
    left join fx_oslp o on o.slpcode = x.slpcode left join (select genid, whscode, pcode, {sum2('amountpaid')} v from fx_history group by 1, 2, 3) a
    on a.genid = x.genid and a.whscode = x.whscode and a.pcode = x.u_paycode)"""


def reviewed(t):
    return r.rebates_detail(t.rac_rbdetailstrans, t.rb_payees, t.oslp, t.rac_payeescheme, t.rac_maintenancecode, t.rac_rbaginghistory)


register("rebates_detail", reviewed, f"select * from {_REVIEWED}")


def _payee_sql(stat: int, where: str = "true") -> str:
    return f"""select d.genid, d.u_paycode, coalesce(p.pname, '') pname, d.rebatesamnt, coalesce(p."class", '') "class", coalesce(p.add1, '') add1,
        coalesce(p.acctnum, '') acctnum, coalesce(p.slpcode, '-1') slpcode, coalesce(o.slpname, '-No Sales Employee-') slpname,
        coalesce(p.hosp, '') hosp, coalesce(p.periodtype, '') periodtype, coalesce(p.dispatchtype, '') dispatchtype,
        coalesce(p.iscrosscheck, 0) iscrosscheck, coalesce(p.isspecialtest, 0) isspecialtest, 0 forpayment
        from (select genid, u_paycode, {sum2('rebatesamnt')} rebatesamnt from st_detail where coalesce(stat, 0) = {stat} and {where} group by 1, 2) d
        left join st_active p on p.pid = d.u_paycode left join fx_oslp o on o.slpcode = p.slpcode"""


register("payee_rebates", lambda t: r.payee_rebates(t.rac_rbdetailstrans, t.rb_payees, t.oslp, stat=0), _payee_sql(0))
register("payee_rebates_approved", lambda t: r.payee_rebates(t.rac_rbdetailstrans, t.rb_payees, t.oslp, stat=1), _payee_sql(1))

_POST = f"""(select genid, u_paycode pid, whscode, isforpayment, {sum2('rebatesamnt')} linetotal from st_detail where stat = 1 group by 1, 2, 3, 4)"""


def posted(t):
    return r.cheque_post(t.rac_rbdetailstrans, t.rb_payees, "2002-02-01")


register("cheque_post", lambda t: posted(t).headers,
         f"""select l.pid, {sum2('l.linetotal')} payment, coalesce(p.iscrosscheck, 0) iscrosscheq, date '2002-02-01' recdate, date '2002-02-01' trandate, p.slpcode, 3 stat,
         l.genid from {_POST} l left join st_active p on p.pid = l.pid group by l.pid, p.iscrosscheck, p.slpcode, l.genid""")
register("cheque_post_lines", lambda t: posted(t).lines, f"select pid, linetotal, whscode, genid from {_POST}")
register("cheque_post_run", lambda t: r.cheque_post_run(reviewed(t), t.rb_payees, "2002-02-01", as_of="2002-02-03").headers,
         f"""select x.u_paycode pid, {sum2('x.actualreb + x.agingreb')} payment, coalesce(p.c, 0) iscrosscheq, date '2002-02-03' recdate, date '2002-02-01' trandate,
         x.slpcode, 3 stat, x.genid from {_REVIEWED} x left join (select pid, max(iscrosscheck) c from fx_payees group by 1) p on p.pid = x.u_paycode
         where x.status = 1 and x.isforpayment = 1 and x.actualreb + x.agingreb <> 0 group by x.u_paycode, p.c, x.slpcode, x.genid""")


register("cheque_post_run_lines", lambda t: r.cheque_post_run(reviewed(t), t.rb_payees, "2002-02-01").lines,
         f"""select u_paycode pid, cast(actualreb + agingreb as decimal(18,2)) linetotal, whscode, genid from {_REVIEWED}
         where status = 1 and isforpayment = 1 and actualreb + agingreb <> 0""")
register("cheque_post_run_dated", lambda t: r.cheque_post_run(reviewed(t), t.rb_payees, "2002-02-01", as_of="2002-02-03", runs=t.soadate).runs.select("genid", "fdate", "tdate", "paymentdate"),
         f"""select genid, fdate, tdate, case when exists (select 1 from {_REVIEWED} x where x.genid = r.genid) then date '2002-02-03' else paymentdate end paymentdate
         from fx_soadate r""")


def posted_with_identity(t):
    """Posted headers appended to the cheque table; their record ids continue after the highest one."""
    batch = posted(t).headers.select("pid", "payment", "iscrosscheq", "trandate", "slpcode", "stat", "genid")
    return k.append_with_identity(t.rac_chequehdr, batch, "recid", ["genid", "pid", "slpcode", "iscrosscheq"]).select(
        "recid", "pid", "payment", "genid")


register("append_with_identity", posted_with_identity,
         f"""select recid, pid, payment, genid from fx_cheques union all
         select (select max(recid) from fx_cheques) + row_number() over (order by genid, pid, slpcode nulls first, iscrosscheq), pid, payment, genid
         from (select l.pid, {sum2('l.linetotal')} payment, coalesce(p.iscrosscheck, 0) iscrosscheq, p.slpcode, l.genid
         from {_POST} l left join st_active p on p.pid = l.pid group by l.pid, p.iscrosscheck, p.slpcode, l.genid)""")


def approved(t):
    """Approve the payees whose branch total of the run exceeds 2,000."""
    details = t.rac_rbdetailstrans
    keys = ["genid", "u_paycode", "whscode"]
    big = details.groupBy(*keys).agg(F.sum("rebatesamnt").alias("s")).where("s > 2000").select(*keys)
    return r.approve_payees(details, big).select("genid", "docentry", "linenum", "u_paycode", "whscode", "isforpayment", "stat")


_BIG = "(select genid, u_paycode, whscode from st_detail group by 1, 2, 3 having sum(rebatesamnt) > 2000)"
register("rebate_status_update", approved,
         f"""select d.genid, d.docentry, d.linenum, d.u_paycode, d.whscode, case when b.genid is not null and d.stat = 0 then 1 else d.isforpayment end isforpayment,
         case when b.genid is not null and d.stat = 0 then 1 else d.stat end stat from st_detail d
         left join {_BIG} b on b.genid = d.genid and b.u_paycode = d.u_paycode and b.whscode = d.whscode""")
register("rebate_status_update_exclude",
         lambda t: r.exclude_documents(t.rbdets, t.rbdets.where("rebate > 3000").select("docentry", "genid").distinct()).select(
             "docentry", "genid", "u_paycode", "whscode", "rebate", "isexcluded"),
         """select docentry, genid, u_paycode, whscode, rebate, case when (docentry, genid) in
         (select (docentry, genid) from st_rbdets where rebate > 3000) then 1 else isexcluded end isexcluded from st_rbdets""")
register("rebate_status_update_documents",
         lambda t: r.mark_documents_for_payment(t.rbdets, t.rb_payees, "ACCOUNT").select(
             "docentry", "genid", "u_paycode", "whscode", "rebate", "isforpaymnt"),
         """select docentry, genid, u_paycode, whscode, rebate, case when docentry in (select d.docentry from st_rbdets d
         join fx_payees p on p.pid = d.u_paycode where p.actype = 'ACCOUNT') then 1 else isforpaymnt end isforpaymnt from st_rbdets""")

_NEXT = "(select max(genid) + 1 nxt from fx_soadate)"
register("generation_list", lambda t: r.generation_list(t.soadate),
         f"""select 0 code, 'Next GenID - ' || nxt "desc", 1 "order" from {_NEXT} union all select genid, cast(genid as varchar), 2 from fx_soadate""")
register("generation_list_unpaid", lambda t: r.generation_list(t.soadate, unpaid_only=True),
         f"""select 0 code, 'Next GenID - ' || nxt "desc", 1 "order" from {_NEXT} union all select genid, cast(genid as varchar), 2 from fx_soadate
         where paymentdate is null""")
register("generation_list_paid_flag", lambda t: r.generation_paid_list(t.soadate, AS_OF),
         f"""select nxt code, 'Next GenID - ' || nxt "desc", date '{AS_OF}' fdate, date '{AS_OF}' tdate, 0 ispaid from {_NEXT}
         union all select genid, cast(genid as varchar), fdate, tdate, case when paymentdate is null then 0 else 1 end from fx_soadate""")
register("generation_list_latest_unpaid", lambda t: r.latest_unpaid_run(t.soadate),
         "select genid, fdate, tdate from fx_soadate where genid in (select max(genid) from fx_soadate where paymentdate is null)")
register("generation_list_labels", lambda t: r.generation_labels(t.soadate),
         """select genid code, genid "desc", strftime(fdate, '%B') || ' ' || day(fdate) || ' - ' || day(tdate) || ', ' || year(fdate) daterange
         from fx_soadate""")
register("generation_list_schedule", lambda t: r.generation_schedule(t.soadate, t.rac_rebschedgeneration),
         """select r.genid, fdate, tdate, asofdate, cast(strptime(cast(schedstartdate as varchar), '%Y%m%d') as date) schedstartdate,
         cast(strptime(cast(schedenddate as varchar), '%Y%m%d') as date) schedenddate, substr(schedstarttime, 1, 2) || ':' || substr(schedstarttime, 3, 2)
         || ':' || substr(schedstarttime, 5, 2) schedstarttime, isenabled from fx_soadate r join fx_schedule s on s.genid = r.genid""")
register("generation_list_newest", lambda t: r.runs_newest_first(t.soadate), 'select genid code, genid "desc" from fx_soadate')
register("generation_list_commission", lambda t: r.commission_run_list(t.rac_commcomputationhdr, AS_OF),
         f"""select 0 code, 'UnProcess' "desc", date '{AS_OF}' datefrom, date '{AS_OF}' dateto union
         select year(fdate) - 1994, cast(year(fdate) - 1994 as varchar), min(fdate), max(tdate) from fx_soadate group by 1, 2""")


def registered(t):
    """Register next year's months: the runs of the past twelve months shifted, with ids still to assign."""
    last = t.soadate.agg(F.max("genid").alias("g")).scalar()
    new = t.soadate.where(F.col("genid") > last - 12).selectExpr("0 as genid", "add_months(fdate, 12) as fdate",
                                                   "last_day(add_months(fdate, 12)) as tdate", "add_months(asofdate, 12) as asofdate")
    return r.generation_register(t.soadate, new).select("genid", "fdate", "tdate")


register("generation_register", registered,
         """select genid, fdate, tdate from fx_soadate union all select (select max(genid) from fx_soadate) + row_number() over (order by fdate),
         cast(fdate + interval 12 month as date), last_day(cast(fdate + interval 12 month as date)) from fx_soadate where genid > (select max(genid) - 12 from fx_soadate)""")


def reset(t, **how):
    details = t.rac_rbdetailstrans
    ledger = details.groupBy("docentry", "linenum").agg(F.min("genid").alias("genid"))
    return r.generation_reset(t.soadate, details, ledger, t.oinv, **how)


_LEDGER = "(select docentry, linenum, min(genid) genid from st_detail group by 1, 2)"
register("generation_reset", lambda t: reset(t, gen_id=80).details.select("genid", "docentry", "linenum", "u_paycode"),
         "select genid, docentry, linenum, u_paycode from st_detail where genid <> 80")
register("generation_reset_refused", lambda t: reset(t, gen_id=40).details.select("genid", "docentry", "linenum", "u_paycode"),
         "select genid, docentry, linenum, u_paycode from st_detail")
register("generation_reset_ledger", lambda t: reset(t, gen_id=79).ledger, f"select * from {_LEDGER} where genid <> 79")
register("generation_reset_forced", lambda t: reset(t, gen_id=40, force=True, frm="1998-03-10", to="1998-05-20").ledger,
         f"""select l.* from {_LEDGER} l join fx_oinv o on o.docentry = l.docentry
         where o.recondate not between date '1998-03-10' and date '1998-05-20'""")
register("next_key", lambda t: k.next_key(t.soadate, "genid"), "select max(genid) + 1 next_key from fx_soadate")


# --- only the runs that change ------------------------------------------------------

def unpaid_totals(t):
    """Branch totals over 2,000 of the runs not paid yet."""
    details = t.rac_rbdetailstrans.join(t.soadate.where("paymentdate is null").select("genid"), "genid", "left_semi")
    return details.groupBy("genid", "u_paycode", "whscode").agg(F.sum("rebatesamnt").alias("s")).where("s > 2000").drop("s")


_OPEN_RUNS = "(select genid from fx_soadate where paymentdate is null)"
register("rebate_status_update_changes",
         lambda t: r.changes_of_status(t.rac_rbdetailstrans, unpaid_totals(t), r.approve_payees).rows.select(
             "genid", "docentry", "linenum", "u_paycode", "whscode", "isforpayment", "stat"),
         f"""select d.genid, d.docentry, d.linenum, d.u_paycode, d.whscode, case when b.genid is not null and d.stat = 0 then 1 else d.isforpayment end isforpayment,
         case when b.genid is not null and d.stat = 0 then 1 else d.stat end stat from st_detail d
         left join {_BIG} b on b.genid = d.genid and b.u_paycode = d.u_paycode and b.whscode = d.whscode
         where d.genid in {_OPEN_RUNS} and d.genid in (select genid from {_BIG})""")


def reset_unpaid(t):
    """Withdraw every second run, as far as it is not paid yet."""
    ledger = t.rac_rbdetailstrans.groupBy("docentry", "linenum").agg(F.min("genid").alias("genid"))
    return r.changes_of_reset(t.soadate, ledger, t.oinv, t.soadate.where("genid % 2 = 0"))


register("generation_reset_changes_dropped", lambda t: reset_unpaid(t).dropped, f"select * from {_OPEN_RUNS} where genid % 2 = 0")
register("generation_reset_changes_ledger", lambda t: reset_unpaid(t).ledger.rows,
         f"""select l.docentry, l.linenum, l.genid from {_LEDGER} l join fx_soadate r on r.genid = l.genid join fx_oinv o on o.docentry = l.docentry
         where r.genid % 2 = 0 and r.paymentdate is null and o.recondate not between r.fdate and r.tdate""")
