"""Rating queries: every step over all runs at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rating as r
from ..operators.banding import for_payment_flag, payee_scheme_banding
from ..functions.money import total
from ..sources.bindings import by_document
from ..sources.store import freeze
from .registry import register
from .results_sql import banding, sum2


def eligible(t):
    return r.rebate_eligible_lines(t.oinv, t.inv1, t.ocrd_ext, t.ocrd, t.rac_rebprclvlmntnce, runs=t.soadate)


def special(t):
    return r.special_test_set(t.item_masterh, t.spclinhouse)


def keyed_lines(t):
    return r.rate_combination_key(r.rebate_exclusions(eligible(t), t.rb_norebate), special(t), t.item_masterh)


def credited(t, scale=0):
    return r.credit_memo_net(keyed_lines(t), t.rin1, scale)


def with_installments(t, scale=0):
    return r.installment_paid(credited(t, scale), t.aopdet2, t.jdt1, t.oact, t.rct2, t.orct, scale)


def split(t, scale=0):
    return r.payee_sharing_split(r.rated_lines(t, runs=t.soadate, scale=scale), t.rb_payees, t.rac_rbsharing, t.ocrd,
                                 t.odrs)


def spread_details(t):
    """All runs with holders and payees of over a thousandth of the lines dealt into slices."""
    few = max(1, t.inv1.count() // 1000)
    return r.rebate_details(t, slice_rows=few, runs=t.soadate)


def run_totals(t):
    return t.rac_rbdetailstrans.groupBy("genid", "u_paycode", "whscode").agg(total("rebatesamnt").alias("rebatesamnt"))


LINE = ["docentry", "linenum", "whscode", "itemcode", "u_labno", "cardcode", "u_doctorcode", "groupcode", "linetotal"]
_LINE = ", ".join(LINE)
_DETAIL = ["genid", "docentry", "linenum", "u_packageno", "itemcode", "whscode", "cardcode", "u_labno", "u_doctorcode",
           "groupcode", "u_paycode", "comtype", "objtype", "linetotal", "u_rate", "u_amount", "u_share", "recondate",
           "docdate", "dedamt", "rebatesamnt", "fund"]
_TOTALS = "(select genid, u_paycode, whscode, " + sum2("rebatesamnt") + " rebatesamnt from st_detail group by 1, 2, 3)"

register("rebate_eligible_lines",
         lambda t: eligible(t).select(*LINE, "pmode", "u_paymenttyp", "rbsenior", "prclvltype", "rbprclvl", "recondate", "genid"),
         f"select {_LINE}, pmode, u_paymenttyp, rbsenior, prclvltype, rbprclvl, recondate, genid from st_elig")
register("special_test_set", special, "select imh_code, whscode from st_special")
register("rate_combination_key",
         lambda t: r.rate_combination_key(eligible(t), special(t), t.item_masterh).select(*LINE, "ratecomb"),
         f"select {_LINE}, ratecomb from st_key_all")
register("rebate_exclusions", lambda t: r.rebate_exclusions(eligible(t), t.rb_norebate).select(*LINE),
         f"select {_LINE} from st_kept")
register("credit_memo_net", lambda t: credited(t).select(*LINE, "cm"), f"select {_LINE}, cm from st_cm_s0")
register("credit_memo_net_exact", lambda t: credited(t, 2).select(*LINE, "cm"), f"select {_LINE}, cm from st_cm_s2")
register("installment_paid", lambda t: with_installments(t).select(*LINE, "ip"), f"select {_LINE}, ip from st_ip_s0")
register("net_positive_filter", lambda t: r.net_positive_filter(with_installments(t)).select(*LINE, "cm", "ip"),
         f"select {_LINE}, cm, ip from st_net_s0")
for _scale, _name in ((0, "rate_waterfall"), (2, "rate_waterfall_exact")):
    register(_name, lambda t, s=_scale: r.rated_lines(t, runs=t.soadate, scale=s).select(*LINE, "rate", "amt", "comtype"),
             f"select {_LINE}, rate, amt, comtype from st_rated_s{_scale}")
register("rate_waterfall_bucketed", lambda t: r.rated_lines(by_document(t), runs=t.soadate).select(*LINE, "rate", "amt", "comtype"),
         f"select {_LINE}, rate, amt, comtype from st_rated_s0")
register("payee_sharing_split", lambda t: split(t).select(*LINE, "u_paycode", "u_payname", "u_share", "u_fund"),
         f"select {_LINE}, u_paycode, u_payname, u_share, u_fund from st_split_s0")
for _scale, _name in ((0, "rebate_amounts"), (2, "rebate_amounts_exact")):
    register(_name, lambda t, s=_scale: r.rebate_amounts(split(t, s), s).select(*_DETAIL),
             f"select {', '.join(_DETAIL)} from st_amounts_s{_scale}")
register("payee_scheme_banding",
         lambda t: payee_scheme_banding(run_totals(t), t.rb_payees, t.rac_payeescheme, t.rac_maintenancecode),
         banding(_TOTALS, ["genid", "u_paycode"]))
register("for_payment_flag",
         lambda t: for_payment_flag(t.rac_rbdetailstrans, t.rb_payees, t.rac_payeescheme, t.rac_maintenancecode).select(
             "genid", "docentry", "linenum", "u_paycode", "whscode", "rebatesamnt", "isforpayment"),
         "select genid, docentry, linenum, u_paycode, whscode, rebatesamnt, isforpayment from st_detail")


def marked(t):
    """Lines marked by the first half of the runs, extended by all runs' details."""
    details = t.rac_rbdetailstrans
    before = r.incremental_line_marking(details.where("genid <= 40"), details.sparkSession.createDataFrame(
        [], "docentry long, linenum int, genid int"))
    return r.incremental_line_marking(details, before)


register("incremental_line_marking", marked,
         "select docentry, linenum, min(genid) genid from st_detail group by 1, 2")
def marked_later(t):
    """What the later half of the runs adds to the ledger of the first half."""
    details = t.rac_rbdetailstrans
    return r.monthly_marks(details.where("genid > 40"), r.monthly_marks(details.where("genid <= 40")))


register("incremental_line_marking_new", marked_later,
         """select docentry, linenum, min(genid) genid, cast(date_trunc('month', min(recondate)) as date) "month" from st_detail d where genid > 40
         and not exists (select 1 from st_detail e where e.genid <= 40 and e.docentry = d.docentry and e.linenum = d.linenum) group by 1, 2""")
register("rebate_generation", lambda t: r.rebate_details(t, runs=t.soadate).select(*_DETAIL, "isforpayment"),
         f"select {', '.join(_DETAIL)}, isforpayment from st_details_s0")
register("rebate_generation_spread", lambda t: spread_details(t).select(*_DETAIL, "isforpayment"),
         f"select {', '.join(_DETAIL)}, isforpayment from st_details_s0")
register("rebate_generation_exact", lambda t: r.rebate_details(t, runs=t.soadate, scale=2).select(*_DETAIL, "isforpayment"),
         f"select {', '.join(_DETAIL)}, isforpayment from st_details_s2")


def whole_span(t, ledger=None):
    """Run 81 over the whole span of the invoices."""
    first, last = (t.oinv.agg(end("recondate").alias("d")).scalar() for end in (F.min, F.max))
    return r.rebate_generation(t, 81, first, last, ledger)


def one_run_over_everything(t):
    """A single run whose dates span all invoices, after a ledger of lines rated before."""
    ledger = freeze(t.rac_rbdetailstrans.where("genid <= 40").select("docentry", "linenum", "genid").distinct(), "ledger")
    return whole_span(t, ledger).details.select("genid", "docentry", "linenum", "u_paycode", "whscode", "comtype", "rebatesamnt", "fund")


register("rebate_generation_run", lambda t: whole_span(t).runs,
         """select 81 genid, min(recondate) fdate, max(recondate) tdate, max(recondate) asofdate, cast(null as date) paymentdate from fx_oinv""")
register("rebate_generation_incremental", one_run_over_everything,
         """select 81 genid, docentry, linenum, u_paycode, whscode, comtype, rebatesamnt, fund from st_amounts_s0 a
         where genid > 40 or not exists (select 1 from st_amounts_s0 e where e.genid <= 40 and e.docentry = a.docentry and e.linenum = a.linenum)""")


def per_payee(t):
    """What each payee earns per branch and run."""
    return r.rebate_amounts(split(t), 0).groupBy("genid", "u_paycode", "whscode").agg(total("rebatesamnt").alias("rebatesamnt"))


register("payee_branch_earnings", per_payee,
         f"select genid, u_paycode, whscode, {sum2('rebatesamnt')} rebatesamnt from st_amounts_s0 group by 1, 2, 3")
