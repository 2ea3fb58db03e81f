"""Aging queries."""

from __future__ import annotations

from ..operators import aging as a
from .registry import CATALOGUE, register
from .results_sql import D2, ages, sum2, zero

AS_OF = "2001-07-15"
_LATEST = "(select max(genid) from fx_soadate where paymentdate is null)"
_CLASSES = ("d01_30", "d31_60", "d61_90", "d91_120", "over120")


def _net(keys: str) -> str:
    on = " and ".join(f"s.{k} = u.{k}" for k in keys.split(", "))
    cols = ", ".join("u." + k for k in keys.split(", "))
    return f"""(select {cols}, u.nodays, {zero('s.v')} amountpaid, cast(coalesce(u.v, 0) - coalesce(s.v, 0) as {D2}) unpaid,
        case when coalesce(s.v, 0) > 0 then 1 else 0 end stat
        from (select {', '.join('p.' + k for k in keys.split(', '))}, abs(date_diff('day', r.paymentdate, date '{AS_OF}')) nodays,
            date_diff('day', r.paymentdate, date '{AS_OF}') d, {sum2('p.unpaidrebates')} v from fx_payments p left join fx_soadate r on r.genid = p.genid
            where coalesce(p.unpaidrebates, 0) <> 0 and p.status = 2 group by all) u
        left join (select {keys}, abs(date_diff('day', createddate, paymentdate)) d, {sum2('amountpaid')} v from fx_history where genid = {_LATEST}
            group by all) s on {on})"""


def _current(keys: str) -> str:
    return f"(select {keys}, {sum2('actualrebates')} v from fx_payments where genid = {_LATEST} and actualrebates <> 0 and status = 1 group by all)"


_SUM = "cast(d01_30 + d31_60 + d61_90 + d91_120 + over120 as decimal(18,2))"


def inputs(t):
    return t.rac_rbpayments, t.rac_rbaginghistory, t.soadate


_BRANCH = f"""(select x.whscode, b.whsname, x.amountpaid, h.budgetamnt, c.v actualrebates, x.nodays, x.unpaid
    from (select whscode, nodays, {sum2('amountpaid')} amountpaid, {sum2('unpaid')} unpaid from {_net('whscode')} group by 1, 2) x
    left join fx_sapset b on b.code = x.whscode left join {_current('whscode')} c on c.whscode = x.whscode
    left join st_hier h on h.genid = {_LATEST} and h.whscode = x.whscode)"""

register("aging_by_branch",
         lambda t: a.aging_by_branch(*inputs(t), t.sapset, t.rac_budgethierarchy, AS_OF),
         f"""select whscode, whsname, amountpaid totamnttopay, {zero('budgetamnt')} budgetamnt, {zero('actualrebates')} currrebs, cast(0 as {D2}) totexcess,
         {', '.join(_CLASSES)}, {_SUM} totalaging from (select whscode, whsname, amountpaid, budgetamnt, actualrebates, nodays, {ages('nodays', 'unpaid')}
         from {_BRANCH} where nodays is not null group by 1, 2, 3, 4, 5, 6)""")
register("aging_by_branch_collapsed",
         lambda t: a.aging_by_branch(*inputs(t), t.sapset, t.rac_budgethierarchy, AS_OF, collapse_days=True),
         f"""select whscode, whsname, paid totamnttopay, {zero('budgetamnt')} budgetamnt, {zero('actualrebates')} currrebs, cast(0 as {D2}) totexcess,
         {', '.join(_CLASSES)}, {_SUM} totalaging from (select w.whscode, whsname, budgetamnt, actualrebates, p.paid, {ages('nodays', 'unpaid')}
         from {_BRANCH} w join (select whscode, {sum2('amountpaid')} paid from {_BRANCH} group by 1) p on p.whscode = w.whscode
         where nodays is not null group by 1, 2, 3, 4, 5)""")
register("aging_by_payee", lambda t: a.aging_by_payee(*inputs(t), t.rb_payees, AS_OF),
         f"""select pcode, pname, whscode, amountpaid amnttopay, {zero('actualrebates')} currrebs, {_SUM} totagingdets, {', '.join(_CLASSES)}, "class", add1,
         hosp, actype, stat from (select x.pcode, p.pname, x.whscode, x.amountpaid, c.v actualrebates, x.nodays, p."class", p.add1, p.hosp, p.actype, x.stat,
         {ages('x.nodays', 'x.unpaid')} from (select pcode, whscode, nodays, stat, {sum2('amountpaid')} amountpaid, {sum2('unpaid')} unpaid
         from {_net('pcode, whscode')} group by 1, 2, 3, 4) x left join {_current('pcode, whscode')} c on c.pcode = x.pcode and c.whscode = x.whscode
         left join fx_payees p on p.pid = x.pcode where x.nodays is not null group by 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)""")


def stored(t):
    return a.DaySums(t.aging_unpaid, t.aging_settled, t.aging_current)


for _name, _of in (("aging_by_branch", lambda t: a.aging_by_branch_of(stored(t), t.soadate, t.sapset, t.rac_budgethierarchy, AS_OF)),
                   ("aging_by_branch_collapsed", lambda t: a.aging_by_branch_of(stored(t), t.soadate, t.sapset, t.rac_budgethierarchy, AS_OF, True)),
                   ("aging_by_payee", lambda t: a.aging_by_payee_of(stored(t), t.soadate, t.rb_payees, AS_OF))):
    register(f"{_name}_stored", _of, CATALOGUE[_name].sql)
register("aging_open_items", lambda t: a.aging_open_items(t.rac_rbpayments, t.soadate),
         f"""select p.recid, p.genid, p.whscode, p.pcode, p.unpaidrebates, cast(0 as {D2}) amnttopay, r.paymentdate from fx_payments p
         left join fx_soadate r on r.genid = p.genid where p.status = 2""")


def settled(t):
    """Pay the items of the history's accounts again: in full where the item was paid in full before."""
    batch = t.rac_rbaginghistory.drop("createddate")
    return a.aging_apply_payment(t.rac_rbpayments, t.rac_rbaginghistory, batch, "u1", AS_OF)


register("aging_apply_payment", lambda t: settled(t).payments.select("recid", "genid", "pcode", "unpaidrebates", "status"),
         """select p.recid, p.genid, p.pcode, p.unpaidrebates, case when h.docid is not null and p.unpaidrebates - h.amountpaid = 0 then 1 else p.status end status
         from fx_payments p left join fx_history h on h.docid = p.recid""")
register("aging_apply_payment_history", lambda t: settled(t).history.select("docid", "pcode", "amountpaid", "createddate"),
         f"select docid, pcode, amountpaid, createddate from fx_history union all select docid, pcode, amountpaid, date '{AS_OF}' from fx_history")
