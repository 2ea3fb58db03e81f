"""Change batches on keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cheques as q
from ..operators import keyed as k
from ..operators import masters as m
from .registry import register
from .results_sql import D2


def new_targets(t):
    """Targets for every rep and period, also those without one so far."""
    return t.calendar.selectExpr("yr", "pd", "explode(sequence(0, 24)) as nk").where("nk % 2 = 1").selectExpr(
        "cast(nk as string) as slpcode", "yr", "pd", "cast(5000 + nk as decimal(18,2)) as amt")


_ODD = f"(select cast(nk as varchar) slpcode, yr, pd, cast(5000 + nk as {D2}) amt from fx_calendar, (select unnest(range(0, 25)) nk) where nk % 2 = 1)"
register("keyed_upsert", lambda t: k.keyed_upsert(t.comtargetdtl, new_targets(t), ["slpcode", "yr", "pd"], {"amt": "amt"}),
         f"""select coalesce(g.slpcode, b.slpcode) slpcode, coalesce(g.yr, b.yr) yr, coalesce(g.pd, b.pd) pd, coalesce(b.amt, g.amt) amt from fx_targets g
         full join {_ODD} b on b.slpcode = g.slpcode and b.yr = g.yr and b.pd = g.pd""")


def employees_as_payees(t):
    return t.scempnew.selectExpr("concat('E', substr(empcode, 2)) as code", "if(deptcode = 18, concat('D', substr(empcode, 2)), empcode) as pid",
                                 "cast(100 as decimal(18,2)) as rate", "cast(0 as decimal(18,2)) as fund")


register("insert_if_absent", lambda t: k.insert_if_absent(t.rac_rbsharing, employees_as_payees(t).withColumn("code", F.col("pid")), ["code", "pid"]),
         f"""select code, pid, rate, fund from fx_sharing union all select x.pid, x.pid, cast(100 as {D2}), cast(0 as {D2})
         from (select case when deptcode = 18 then 'D' || substr(empcode, 2) else empcode end pid from fx_emp) x
         where not exists (select 1 from fx_sharing s where s.code = x.pid and s.pid = x.pid)""")


def tagging(t):
    """Tag every account invoiced since 2001."""
    return t.oinv.where("docdate >= date'2001-01-01'").select("cardcode").distinct().withColumn("expiry", F.lit("2002-12-31").cast("date"))


register("keyed_update",
         lambda t: k.keyed_update(t.ocrd, tagging(t), ["cardcode"], {"rbprclvl": F.lit(1), "rbexpdt": "expiry", "rbdatetagged": F.lit("2001-08-01").cast("date")}).select(
             "cardcode", "rebrates", "rbprclvl", "rbexpdt", "rbdatetagged"),
         """select o.cardcode, o.rebrates, case when b.cardcode is not null then 1 else rbprclvl end rbprclvl,
         case when b.cardcode is not null then date '2002-12-31' else rbexpdt end rbexpdt, case when b.cardcode is not null then date '2001-08-01' else rbdatetagged end rbdatetagged
         from fx_ocrd o left join (select distinct cardcode from fx_oinv where docdate >= date '2001-01-01') b on b.cardcode = o.cardcode""")
register("keyed_update_cheques_processed",
         lambda t: q.mark_processed_cheques(t.rac_chequehdr.withColumn("stat", F.lit(3)), t.passbook.join(
             t.rac_chequehdr.select("genid", F.col("cheqnum").alias("chknum"), "acctno"), ["chknum", "acctno"]).select(
             "genid", F.col("chknum").alias("cheqnum"), "acctno")).select("recid", "cheqnum", "genid", "stat"),
         """select c.recid, c.cheqnum, c.genid, case when p.chknum is not null then 4 else 3 end stat from fx_cheques c
         left join fx_passbook p on p.chknum = c.cheqnum and p.acctno = c.acctno""")


def inhouse_batch(t):
    return t.spclinhouse.where("itemtype = 'P'").selectExpr("itemcode", "itemname", "whscode", "grpcode", "itemtype", "cardcode",
                                                            "rate + 1 as rate", "cast(7 as decimal(18,2)) as amt")


register("keyed_update_inhouse_rates", lambda t: m.update_special_inhouse(t.spclinhouse, inhouse_batch(t)),
         f"""select itemcode, itemname, whscode, grpcode, itemtype, cardcode, cast(case when itemtype = 'P' then rate + 1 else rate end as {D2}) rate,
         cast(case when itemtype = 'P' then 7 else amt end as {D2}) amt from fx_spcl""")
register("delete_where", lambda t: k.delete_where(t.rac_payeescheme, F.expr("payeetype = 1")),
         "select * from fx_scheme where payeetype <> 1")
register("delete_where_keys", lambda t: k.delete_where(t.rac_rbpayments, batch=t.rac_rbaginghistory.select(F.col("docid").alias("recid")), keys=["recid"]),
         "select * from fx_payments p where not exists (select 1 from fx_history h where h.docid = p.recid)")
register("key_existence",
         lambda t: k.key_existence(t.rac_rbdetailstrans, t.soadate, ["genid"], F.col("stat") == 2),
         "select r.genid, case when exists (select 1 from st_detail d where d.genid = r.genid and d.stat = 2) then 1 else 0 end found from fx_soadate r")
register("key_existence_free_numbers",
         lambda t: k.key_existence(t.checkbookdtl.join(t.checkbook, "id"), t.rac_chequehdr.where("cheqnum is not null").select(
             "acctno", F.col("cheqnum").alias("chknum")), ["acctno", "chknum"], F.expr("stat = 0")),
         """select c.acctno, c.cheqnum chknum, max(case when d.stat = 0 then 1 else 0 end) found from fx_cheques c left join fx_book b on b.acctno = c.acctno
         left join fx_bookdtl d on d.id = b.id and d.chknum = c.cheqnum where c.cheqnum is not null group by 1, 2""")


# --- only the partitions a batch touches ------------------------------------------

PARTS = 64


def _part(*keys: str) -> str:
    """The partition of a key in SQL."""
    text = " || '|' || ".join(f"coalesce(cast({k} as varchar), '')" for k in keys)
    return f"(('0x' || substr(md5({text}), 1, 7))::bigint % {PARTS})::int"


def late_targets(t):
    """New targets for the last period, in the partitions those keys lie in."""
    last = t.calendar.agg(F.max(F.struct("yr", "pd")).alias("p")).scalar()
    return new_targets(t).where((F.col("yr") == last["yr"]) & (F.col("pd") == last["pd"]))


_LATE = f"(select * from {_ODD} where (yr, pd) in (select (yr, pd) from fx_calendar order by yr desc, pd desc limit 1))"
_TARGETS = f"(select *, {_part('slpcode', 'yr', 'pd')} part from fx_targets)"
_LATE_PARTS = f"(select distinct {_part('slpcode', 'yr', 'pd')} from {_LATE})"
register("keyed_upsert_changes",
         lambda t: k.changes_of_upsert(k.with_part(t.comtargetdtl, ["slpcode", "yr", "pd"], PARTS), late_targets(t), ["slpcode", "yr", "pd"], {"amt": "amt"}, PARTS).rows,
         f"""select coalesce(g.slpcode, b.slpcode) slpcode, coalesce(g.yr, b.yr) yr, coalesce(g.pd, b.pd) pd, coalesce(b.amt, g.amt) amt,
         coalesce(g.part, {_part('b.slpcode', 'b.yr', 'b.pd')}) part from (select * from {_TARGETS} where part in {_LATE_PARTS}) g
         full join {_LATE} b on b.slpcode = g.slpcode and b.yr = g.yr and b.pd = g.pd""")


def last_month(t):
    """The accounts invoiced on the last day of all."""
    return t.oinv.where(F.col("docdate") == t.oinv.agg(F.max("docdate")).scalar()).select("cardcode").distinct()


_LAST_DAY = "(select distinct cardcode from fx_oinv where docdate = (select max(docdate) from fx_oinv))"
_ACCOUNTS = f"(select cardcode, rebrates, rbprclvl, {_part('cardcode')} part from fx_ocrd)"
_TOUCHED = f"part in (select {_part('cardcode')} from {_LAST_DAY})"
register("keyed_update_changes",
         lambda t: k.changes_of_update(k.with_part(t.ocrd.select("cardcode", "rebrates", "rbprclvl"), ["cardcode"], PARTS),
                                       last_month(t).withColumn("level", F.lit(1)), ["cardcode"], {"rbprclvl": "level"}, PARTS).rows,
         f"""select a.cardcode, rebrates, case when b.cardcode is not null then 1 else rbprclvl end rbprclvl, part from {_ACCOUNTS} a
         left join {_LAST_DAY} b on b.cardcode = a.cardcode where {_TOUCHED}""")
register("delete_where_changes",
         lambda t: k.changes_of_delete(k.with_part(t.ocrd.select("cardcode", "rebrates", "rbprclvl"), ["cardcode"], PARTS), last_month(t), ["cardcode"], PARTS).rows,
         f"select * from {_ACCOUNTS} a where {_TOUCHED} and not exists (select 1 from {_LAST_DAY} b where b.cardcode = a.cardcode)")
