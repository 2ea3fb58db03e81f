"""Input tables derived from the provided star schema.

The operators expect invoices, masters, rates and cheques; the provided data
are orders, line items, customers, suppliers, parts, nations and events.  Each
function below derives one input table with Spark, so every registered query
grows with the given data.  What the business would find stored (invoices and
their lines, runs, rated details, commission details) is staged as written
tables, so each query reads it the way it would read its warehouse.

``nn`` is a nation key padded to three digits (the branch code); ``genid`` of a
month is ``(year - 1995) * 12 + month``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import AMOUNT
from ..operators.skew import never_sent
from ..session import tune
from .store import staged, staged_bucketed
from .tables import Tables

# The branch keys of the star schema's nation table.
BRANCHES = "sequence(0, 24)"
LAST_RUN = 80
LAST_PAID_RUN = 76

_recipes = {}


def recipe(build):
    _recipes[build.__name__] = build
    return build


def bind(spark: SparkSession, sf_dir: str) -> Tables:
    """All derived input tables over the parquet folder ``sf_dir``."""
    tune(spark)
    raw = Tables.parquet(spark, sf_dir)
    t = Tables(lambda name: _recipes[name](t, raw))
    t._spark, t._scope = spark, sf_dir
    return t


#: Facts that are also stored bucketed by document.
BY_DOCUMENT = ("oinv", "inv1", "aopdet2", "rct2")
BUCKETS = 16


def by_document(t: Tables) -> Tables:
    """The same tables with the large facts laid out by document, as a warehouse would keep them."""
    return Tables(lambda name: staged_bucketed(t._spark, t._scope, f"{name}_by_document", lambda: t[name], ["docentry"], BUCKETS)
                  if name in BY_DOCUMENT else t[name])


def _gen(date: str) -> str:
    return f"(year({date}) - 1995) * 12 + month({date})"


def _nn(key: str) -> str:
    return f"lpad(cast({key} as string), 3, '0')"


# --- invoices -----------------------------------------------------------------

@recipe
def oinv(t, raw) -> DataFrame:
    def build():
        return raw.orders.join(never_sent(raw.customer), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
            "o_orderkey as docentry", "concat('L', o_orderkey) as labno",
            "concat('C', c_custkey) as cardcode", "c_name as cardname",
            "to_date(o_orderdate) as docdate", "to_date(o_orderdate) as recondate",
            f"{_nn('c_nationkey')} as whscode", "left(o_orderpriority, 1) as pmode")
    return staged(t._spark, t._scope, "invoices", build)


@recipe
def line_base(t, raw) -> DataFrame:
    """Line items brought to one row per (order, line number), with their branch.

    Dealt by order before anything else: the least of a text is found by sorting, which so happens in partitions of
    a bounded size and not over all that a task has read, and the join by order finds its lines in place.
    """
    def build():
        lines = raw.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
        lines = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_partkey").alias("partkey"), F.min("l_suppkey").alias("suppkey"),
            F.sum(F.col("l_extendedprice").cast(AMOUNT)).cast(AMOUNT).alias("linetotal"),
            F.min("l_returnflag").alias("rf"), F.min("l_linestatus").alias("ls"))
        head = t.oinv.selectExpr("docentry", "labno", "whscode", "docdate")
        return lines.join(never_sent(head), F.col("l_orderkey") == F.col("docentry")).drop("l_orderkey").withColumnRenamed(
            "l_linenumber", "linenum")
    return staged(t._spark, t._scope, "invoice_lines", build)


@recipe
def inv1(t, raw) -> DataFrame:
    return t.line_base.selectExpr(
        "docentry", "linenum", "cast(partkey as string) as itemcode", "labno as u_labno",
        "if(linenum % 3 = 0, 'P1', '') as u_packageno",
        "if(suppkey = 3, '00', concat('D', suppkey)) as u_doctorcode",
        "cast(1 + (docentry + linenum) % 8 as string) as u_paymenttyp",
        "if(docentry % 11 = 0, 'HP01', 'LB01') as u_source", "whscode", "linetotal")


@recipe
def rin1(t, raw) -> DataFrame:
    return t.line_base.where("rf = 'R'").selectExpr(
        "if(ls = 'F', docentry, null) as baseref", "if(ls = 'F', linenum, null) as baseline",
        "labno as u_labno", "whscode", "cast(partkey as string) as itemcode",
        "cast(if(docentry % 7 = 0, linetotal, cast(linetotal * 0.25 as decimal(18,2)))"
        " as decimal(18,2)) as linetotal")


@recipe
def aopdet2(t, raw) -> DataFrame:
    return t.line_base.where("rf = 'A'").selectExpr(
        "docentry", "linenum", "docentry as docnum",
        "cast(linetotal * 0.30 as decimal(18,2)) as linetotal")


@recipe
def rct2(t, raw) -> DataFrame:
    return raw.orders.selectExpr("o_orderkey as docnum", "o_orderkey as docentry")


@recipe
def orct(t, raw) -> DataFrame:
    return raw.orders.selectExpr("o_orderkey as docnum",
                                 "if(o_orderkey % 13 = 0, 'Y', 'N') as canceled")


@recipe
def jdt1(t, raw) -> DataFrame:
    return t.line_base.selectExpr(
        "docentry as transid",
        "concat(if(partkey % 3 = 0, '40100', '50000'), '-', whscode) as account",
        "linetotal as credit",
        "cast(if(rf = 'R', cast(linetotal * 0.10 as decimal(18,2)), 0) as decimal(18,2)) as debit",
        "docentry as baseref", "if(rf = 'A', 24, 13) as transtype")


@recipe
def ojdt(t, raw) -> DataFrame:
    return raw.orders.selectExpr("o_orderkey as transid", "to_date(o_orderdate) as refdate")


@recipe
def oact(t, raw) -> DataFrame:
    return raw.nation.selectExpr(
        f"{_nn('n_nationkey')} as nn", "n_name", "explode(array('40100', '50000')) as segment_0"
    ).selectExpr("concat(segment_0, '-', nn) as acctcode", "segment_0", "nn as segment_1",
                 "concat(segment_0, nn) as formatcode",
                 "concat(if(segment_0 = '40100', 'SALES ', 'OTHER '), n_name) as acctname")


# --- accounts, clinicians, reps -----------------------------------------------

@recipe
def ocrd(t, raw) -> DataFrame:
    return raw.customer.selectExpr(
        "concat('C', c_custkey) as cardcode", "c_name as u_cardname",
        "cast(c_custkey % 5 * 2 as decimal(18,2)) as rebrates",
        "if(c_custkey % 3 = 0, 0, 1) as rbprclvl",
        "if(c_custkey % 3 = 0, null, date'2001-12-31') as rbexpdt",
        "if(c_custkey % 3 = 0, null, date'1999-06-30') as rbdatetagged",
        "if(c_custkey % 4 = 0, 1, 0) as rbsenior", "0 as member", "cast(null as int) as pwd",
        "if(c_custkey % 10 = 9, 0, 1) as isactive")


@recipe
def ocrd_ext(t, raw) -> DataFrame:
    return raw.customer.selectExpr(
        "concat('C', c_custkey) as cardcode", "c_name as cardname",
        "if(c_custkey % 50 = 0, 'S', 'C') as cardtype",
        "if(c_mktsegment in ('BUILDING', 'MACHINERY'), 100, 102) as groupcode",
        "concat('ADDR ', c_nationkey) as address",
        "if(c_custkey % 97 = 0, null, lpad(cast(1 + c_custkey % 7 as string), 2, '0'))"
        " as u_accounttype")


_DCODE = "if(s_suppkey = 3, '00', concat('D', s_suppkey))"
_HOSP = "case s_suppkey % 4 when 0 then 'INCIDENTAL' when 1 then 'CENTRAL' when 2 then 'NORTH' end"


@recipe
def odrs(t, raw) -> DataFrame:
    return raw.supplier.selectExpr(
        f"{_DCODE} as dcode", "s_name as dname", f"{_HOSP} as hosp",
        f"{_nn('s_nationkey')} as u_location", "concat('ADDR ', s_suppkey) as add1",
        "cast(null as string) as sched", "cast(s_nationkey as string) as slpcode",
        "if(s_suppkey % 3 = 0, 'GP', 'SURGEON') as specialization",
        "concat('AC', s_suppkey % 3) as acctno", "concat('0', s_suppkey) as phone1",
        "cast(null as string) as email", "cast(null as string) as remarks")


@recipe
def rb_norebate(t, raw) -> DataFrame:
    return raw.supplier.where("s_suppkey % 9 = 8").selectExpr(
        f"{_DCODE} as cardcode", "'102' as groupcode")


@recipe
def oslp_ext(t, raw) -> DataFrame:
    return raw.nation.where("n_nationkey <> 24").selectExpr(
        "cast(n_nationkey as string) as slpcode", "concat('REP ', n_name) as slpname")


@recipe
def oslp(t, raw) -> DataFrame:
    return raw.nation.join(raw.region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "cast(n_nationkey as string) as slpcode", "concat('REP ', n_name) as slpname",
        "if(n_nationkey % 5 = 0, null, r_name) as district",
        "if(n_nationkey % 3 = 0, null, 'SENIOR') as position", "cast(null as string) as email",
        "cast(n_nationkey * 10 as decimal(18,2)) as incentive",
        "if(n_nationkey % 2 = 0, 'FIX', null) as comtype", "cast(null as string) as atm",
        f"{_nn('n_nationkey')} as whscode",
        "if(n_nationkey % 4 = 3, null, concat('E', n_nationkey)) as empid",
        "cast(50 as decimal(18,2)) as salesqualifier", "cast(40 as decimal(18,2)) as callsqualifier")


@recipe
def scempnew(t, raw) -> DataFrame:
    return raw.supplier.selectExpr(
        "concat('E', s_suppkey) as empcode", "concat('f', s_suppkey) as fname",
        "if(s_suppkey % 6 = 0, null, 'mid') as mname", "concat('l', s_suppkey) as lname",
        "s_name as empname", f"{_nn('s_nationkey')} as branchcode",
        "if(s_suppkey % 2 = 0, 18, 7) as deptcode",
        "if(s_suppkey % 8 = 0, null, date_add(date'1990-01-01', cast(s_suppkey % 3000 as int)))"
        " as datehired")


@recipe
def bpslp(t, raw) -> DataFrame:
    accounts = raw.customer.where("c_custkey % 12 <> 11").selectExpr(
        "100 as stype", "concat('C', c_custkey) as bpcode", "c_name as bpname", "c_nationkey as nk")
    clinicians = raw.supplier.where("s_suppkey % 12 <> 11").selectExpr(
        "102 as stype", f"{_DCODE} as bpcode", "s_name as bpname", "s_nationkey as nk")
    return accounts.unionByName(clinicians).selectExpr(
        "*", "explode(array(0, 1)) as part"
    ).selectExpr(
        "stype", "bpcode", "bpname", "cast((nk + part) % 25 as string) as slpcode",
        "if(part = 0, date'1990-01-01', date'1998-07-01') as encodedate",
        "if(part = 0, date'1990-01-01', date'1998-07-01') as sdate",
        "if(part = 0, date'1998-06-30', date'2099-12-31') as edate")


# --- items and rates ----------------------------------------------------------

_GROUP = "if(p_type = 'PROMO', 'SP', p_type)"


@recipe
def item_masterh(t, raw) -> DataFrame:
    return raw.part.selectExpr(
        "cast(p_partkey as string) as imh_code", "p_name as imh_desc",
        "if(p_size % 2 = 1, 'P', 'S') as imh_type",
        "case p_size when 1 then '5000' when 2 then '5010' else '1000' end as imh_billcode",
        f"{_GROUP} as ti_test_grp", f"explode({BRANCHES}) as nk"
    ).selectExpr("imh_code", "imh_desc", "imh_type", "imh_billcode", "ti_test_grp",
                 f"{_nn('nk')} as whscode")


@recipe
def item_masterd(t, raw) -> DataFrame:
    return raw.part.where("p_size % 2 = 1").selectExpr(
        "cast(p_partkey as string) as imd_pkg_code", "concat('I', p_partkey) as imd_pkg_item",
        f"explode({BRANCHES}) as nk"
    ).selectExpr("imd_pkg_code", "imd_pkg_item", f"{_nn('nk')} as whscode")


@recipe
def spclinhouse(t, raw) -> DataFrame:
    return raw.part.where("p_partkey % 17 = 0").selectExpr(
        "*", "explode(if(p_partkey % 34 = 0, array(0, 1), array(0))) as twin"
    ).selectExpr("*", "explode(sequence(0, 24, 2)) as nk").selectExpr(
        "cast(p_partkey as string) as itemcode", "p_name as itemname", f"{_nn('nk')} as whscode",
        "cast(10 + p_size % 20 + twin * 5 as decimal(18,2)) as rate",
        "cast(if(p_size % 3 = 0, 25, 0) as decimal(18,2)) as amt",
        "if(p_partkey % 2 = 0, '102', '100') as grpcode",
        "if(p_size % 2 = 1, 'P', 'S') as itemtype",
        "if(twin = 1, 'C1', if(p_partkey % 2 = 0, null, concat('C', p_partkey % 100))) as cardcode")


@recipe
def rac_rebprclvlmntnce(t, raw) -> DataFrame:
    return raw.nation.where("n_nationkey % 5 <> 4").selectExpr(
        f"{_nn('n_nationkey')} as whs", "1 + n_nationkey % 3 as prclvltype")


@recipe
def price_level_hdr(t, raw) -> DataFrame:
    return raw.region.selectExpr("*", "explode(array('N', 'S')) as pricetype").selectExpr(
        "concat('R', r_regionkey) as company", "concat(r_name, '1') as price_level1",
        "concat(r_name, '2') as price_level2",
        "if(r_regionkey = 0, null, concat(r_name, '3')) as price_level3", "pricetype")


@recipe
def sapset(t, raw) -> DataFrame:
    return raw.nation.selectExpr(
        f"{_nn('n_nationkey')} as code", "concat('BRANCH ', n_name) as whsname", "n_name as blk",
        "if(n_nationkey % 10 = 9, 'C', 'O') as stat", "if(n_nationkey % 10 = 8, 'C', 'O') as slsstat",
        "concat('R', n_regionkey) as lisgrp")


@recipe
def test_group(t, raw) -> DataFrame:
    return raw.part.selectExpr(f"{_GROUP} as tg_code").distinct().selectExpr(
        "tg_code", "concat('GROUP ', tg_code) as tg_name")


@recipe
def rac_rebratecombination(t, raw) -> DataFrame:
    """The rate dictionary: clinician rows by branch and level, account rows without.

    Stored, so that its true size is known when a join is planned.
    """
    return staged(t._spark, t._scope, "rates", lambda: _rate_dictionary(t))


def _rate_dictionary(t) -> DataFrame:
    base = t.test_group.selectExpr(
        "tg_code as testgrp", "(ascii(tg_code) * 100 + ascii(substr(tg_code, 2, 1))) as gi",
        "explode(array(1, 2, 3, 4, 7)) as pay"
    ).selectExpr("*", "explode(array(0, 1)) as snr").selectExpr("*", "explode(array(0, 2, 3)) as pkg")
    clinician = base.selectExpr("*", "explode(sequence(1, 5)) as pm").selectExpr(
        "*", f"explode({BRANCHES}) as nk").where("nk % 5 <> 4").selectExpr(
        "cast(gi as bigint) * 100000000 + pm * 10000000 + pay * 1000000 + snr * 100000 + pkg * 10000"
        " + nk as ratecode",
        f"concat(pm, lpad(cast(pay as string), 2, '0'), snr, pkg, 1 + nk % 3, {_nn('nk')}, testgrp)"
        " as ratedesc",
        "cast(pm as string) as pmode", "lpad(cast(pay as string), 2, '0') as accttype",
        "cast(snr as string) as senior", "cast(pkg as string) as pcktype",
        "cast(1 + nk % 3 as string) as prclvl", f"{_nn('nk')} as whs", "testgrp",
        "cast(5 + pay + pkg as decimal(18,2)) as rate", "cast(0 as decimal(18,2)) as amount",
        "102 as type")
    account = base.selectExpr(
        "cast(gi as bigint) * 100000000 + pay * 1000000 + snr * 100000 + pkg * 10000 + 99 as ratecode",
        "concat(lpad(cast(pay as string), 2, '0'), snr, pkg, testgrp) as ratedesc",
        "cast(null as string) as pmode", "lpad(cast(pay as string), 2, '0') as accttype",
        "cast(snr as string) as senior", "cast(pkg as string) as pcktype",
        "cast(null as string) as prclvl", "cast(null as string) as whs", "testgrp",
        "cast(5 + pay + pkg as decimal(18,2)) as rate", "cast(0 as decimal(18,2)) as amount",
        "100 as type")
    return clinician.unionByName(account)


@recipe
def rac_rebtestmntnce(t, raw) -> DataFrame:
    return raw.part.where("p_partkey % 5 = 0").selectExpr("*", f"explode({BRANCHES}) as nk").selectExpr(
        "cast(p_partkey as string) as imh_code",
        "if(p_size % 2 = 1, concat('I', p_partkey), null) as imd_pkg_item", f"{_nn('nk')} as whscode",
        "cast(10 + nk as decimal(18,2)) as rate", "cast(p_size as decimal(18,2)) as amnt", "1 as stat")


@recipe
def oitm(t, raw) -> DataFrame:
    return raw.part.selectExpr("cast(p_partkey as string) as itemcode", "p_name as itemname",
                               "if(p_size % 2 = 0, 'N', 'Y') as invntitem")


@recipe
def cust_master_orcl(t, raw) -> DataFrame:
    return raw.customer.selectExpr("*", "explode(array(0, 1)) as folder").selectExpr(
        "concat('C', c_custkey) as dbcode", f"concat('F', folder, {_nn('c_nationkey')}) as folder_id")


# --- payees -------------------------------------------------------------------

@recipe
def rb_payees(t, raw) -> DataFrame:
    clinician = raw.supplier.selectExpr(
        "*", "explode(if(s_suppkey % 5 = 0, array('', '-S'), array(''))) as sfx"
    ).selectExpr(
        f"concat({_DCODE}, sfx) as pid", f"{_DCODE} as code",
        "if(sfx = '', s_name, concat(s_name, ' SEC')) as pname",
        "if(sfx = '', 'Clinician', 'Secretary') as class", "concat('AC', s_suppkey) as acctnum",
        "if(s_suppkey % 6 = 0, null, concat('ADDR ', s_suppkey)) as add1",
        "cast(s_nationkey as string) as slpcode", f"{_HOSP} as hosp", "cast(null as string) as telno",
        "'CLINICIAN' as actype", "'MONTHLY' as periodtype",
        "if(s_suppkey % 3 = 0, null, 'PICKUP') as dispatchtype",
        "if(s_suppkey % 7 = 0, null, cast(s_suppkey % 2 as int)) as iscrosscheck",
        "0 as isspecialtest", "if(s_suppkey % 10 = 9, 0, 1) as isactive")
    account = raw.customer.selectExpr(
        "concat('A', c_custkey) as pid", "concat('C', c_custkey) as code", "c_name as pname",
        "'Account' as class", "concat('AC', c_custkey) as acctnum",
        "if(c_custkey % 6 = 0, null, concat('ADDR ', c_custkey)) as add1",
        "cast(c_nationkey as string) as slpcode", "cast(null as string) as hosp",
        "cast(null as string) as telno", "'ACCOUNT' as actype", "'QUARTERLY' as periodtype",
        "if(c_custkey % 3 = 0, null, 'MAIL') as dispatchtype",
        "if(c_custkey % 7 = 0, null, cast(c_custkey % 2 as int)) as iscrosscheck",
        "1 as isspecialtest", "if(c_custkey % 10 = 9, 0, 1) as isactive")
    return clinician.unionByName(account)


@recipe
def rac_rbsharing(t, raw) -> DataFrame:
    clinician = raw.supplier.selectExpr(
        "*", "explode(if(s_suppkey % 5 = 0, array('', '-S'), array(''))) as sfx"
    ).selectExpr(
        f"{_DCODE} as code", f"concat({_DCODE}, sfx) as pid",
        "cast(if(sfx = '-S', 20, if(s_suppkey % 5 = 0, 80, 100)) as decimal(18,2)) as rate",
        "cast(if(sfx = '' and s_suppkey % 4 = 0, 5, 0) as decimal(18,2)) as fund")
    account = raw.customer.selectExpr(
        "concat('C', c_custkey) as code", "concat('A', c_custkey) as pid",
        "cast(100 as decimal(18,2)) as rate",
        "cast(if(c_custkey % 4 = 0, 5, 0) as decimal(18,2)) as fund")
    return clinician.unionByName(account)


@recipe
def oacs1(t, raw) -> DataFrame:
    """Share rows per clinician and branch; the last branches have none yet."""
    return raw.supplier.where("s_suppkey % 2 = 0").selectExpr(
        "*", "explode(sequence(0, 19)) as nk").selectExpr(
        f"{_DCODE} as code", "nk + 1 as lineid", f"{_DCODE} as u_paycode", "s_name as u_payname",
        f"{_nn('nk')} as u_branch", "concat('NATION_', nk) as u_bname", "'Clinician' as u_class",
        "concat('AC', s_suppkey) as u_acntno", "cast(100 as decimal(18,2)) as u_share")


@recipe
def rac_payeescheme(t, raw) -> DataFrame:
    return raw.nation.where("n_nationkey % 6 <> 5").selectExpr(
        "*", "explode(array(1, 2)) as payeetype").selectExpr(
        "*", "explode(array(1, 2)) as linenum").selectExpr(
        "linenum", "payeetype", f"{_nn('n_nationkey')} as whs",
        "cast(if(linenum = 1, 0, 10000) as decimal(18,2)) as rangefrom",
        "cast(if(linenum = 1, 9999.99, 9999999) as decimal(18,2)) as rangeto",
        "cast(if(linenum = 1, 80, 100) as decimal(18,2)) as percnt",
        "cast(500 as decimal(18,2)) as amntexclusion")


# The code table of the maintenance screens.
MAINTENANCE_CODES = [
    (1, "RebatesPayee", "PayeeType", "PayeeType", "1", "CLINICIAN", 1),
    (2, "RebatesPayee", "PayeeType", "PayeeType", "2", "ACCOUNT", 1),
    (3, "Cheque Monitoring", "VoidType", "VoidType", "1", "CANCELLED", 1),
    (4, "Cheque Monitoring", "VoidType", "VoidType", "2", "STALED", 1),
    (5, "RebRateMntnce", "Discount", "Senior", "0", "REGULAR", 1),
    (6, "RebRateMntnce", "Discount", "Senior", "1", "SENIOR", 1),
    (7, "RebRateMntnce", "Package", "Package", "0", "NO PACKAGE", 1),
    (8, "RebRateMntnce", "Package", "Package", "2", "NORMAL", 1),
    (9, "RebRateMntnce", "Package", "Package", "3", "SPECIAL", 1),
    (10, "RebRateMntnce", "PrcLvl", "PrcLvlType", "1", "LEVEL A", 1),
    (11, "RebRateMntnce", "PrcLvl", "PrcLvlType", "2", "LEVEL B", 1),
]


@recipe
def rac_maintenancecode(t, raw) -> DataFrame:
    return t._spark.createDataFrame(
        MAINTENANCE_CODES,
        "recid int, module string, type string, `group` string, code string, `desc` string, isactive int")


@recipe
def rac_budgetcriteria(t, raw) -> DataFrame:
    return raw.nation.where("n_nationkey % 7 <> 6").selectExpr(
        "explode(array('CLINICIAN', 'ACCOUNT')) as accounttype", f"{_nn('n_nationkey')} as whscode",
        "cast(1000 as decimal(18,2)) as amntexcluded")


# --- calendars and runs -------------------------------------------------------

@recipe
def months(t, raw) -> DataFrame:
    return raw.orders.selectExpr("cast(trunc(o_orderdate, 'MM') as date) as fdate").distinct()


@recipe
def soadate(t, raw) -> DataFrame:
    def build():
        return t.months.selectExpr(
            f"cast({_gen('fdate')} as int) as genid", "fdate", "last_day(fdate) as tdate",
            "last_day(fdate) as asofdate",
            f"if({_gen('fdate')} <= {LAST_PAID_RUN}, date_add(last_day(fdate), 15), null) as paymentdate")
    return staged(t._spark, t._scope, "soadate", build)


@recipe
def rac_rebschedgeneration(t, raw) -> DataFrame:
    return t.soadate.selectExpr(
        "genid", "cast(date_format(fdate, 'yyyyMMdd') as int) as schedstartdate",
        "cast(date_format(tdate, 'yyyyMMdd') as int) as schedenddate",
        "concat(lpad(cast(genid % 24 as string), 2, '0'), '3000') as schedstarttime",
        "genid % 2 as isenabled")


@recipe
def calendar(t, raw) -> DataFrame:
    return t.soadate.selectExpr("year(fdate) as yr", "month(fdate) as pd")


@recipe
def rac_commqualifiers(t, raw) -> DataFrame:
    return t.calendar.selectExpr("*", f"explode({BRANCHES}) as nk").where("nk % 8 <> 7").selectExpr(
        "cast(nk as string) as slpcode", "pd as month", "yr as year",
        "cast(50 + (nk + pd) % 50 as decimal(18,2)) as salesqualifier",
        "cast(40 + nk % 60 as decimal(18,2)) as callsqualifier",
        "cast(90 - nk as decimal(18,2)) as callsperformance")


@recipe
def comtargetdtl(t, raw) -> DataFrame:
    return t.calendar.selectExpr("*", f"explode({BRANCHES}) as nk").where("nk % 8 <> 7").selectExpr(
        "cast(nk as string) as slpcode", "yr", "pd",
        "cast(100000 + 1000 * nk as decimal(18,2)) as amt")


@recipe
def commschemehdr(t, raw) -> DataFrame:
    return raw.region.selectExpr(
        "r_regionkey as schemecode", "make_date(1995 + r_regionkey, 1, 1) as datestarted",
        "if(r_regionkey = 4, null, make_date(1996 + r_regionkey, 6, 30)) as dateended")


@recipe
def commschemedtl(t, raw) -> DataFrame:
    return raw.nation.selectExpr(
        "n_regionkey as schemecode", "cast(n_nationkey * 10000 as decimal(18,2)) as amtfr",
        "cast(n_nationkey * 10000 + 9999.99 as decimal(18,2)) as amtto",
        "cast(1 + n_nationkey % 5 as decimal(18,2)) as prcnt",
        "if(n_nationkey % 4 = 0, 'MISSION', 'REGULAR') as commtype", "n_nationkey as orderby",
        "if(n_nationkey % 6 = 5, 1, 0) as isdeleted")


# --- stored results of earlier steps -------------------------------------------

@recipe
def rac_commcomputationdtl(t, raw) -> DataFrame:
    """Commission details of one run per year; odd runs are processed."""
    from ..operators.commission import commission_lines

    def build():
        return commission_lines(t).selectExpr(
            "docentry", "docdate", "labno", "linenum", "itemcode", "whscode", "slpcode", "groupcode",
            "bpcode", "bpname", "hospital", "linetotal", "paid", "ti_test_grp",
            "(year(docdate) - 1994) % 2 as isprocess", "year(docdate) - 1994 as genid")
    return staged(t._spark, t._scope, "commission_details", build, "genid")


@recipe
def rac_commcomputationhdr(t, raw) -> DataFrame:
    return t.soadate.groupBy(F.expr("year(fdate) - 1994").alias("genid")).agg(
        F.min("fdate").alias("datefrom"), F.max("tdate").alias("dateto"))


@recipe
def rac_rbdetailstrans(t, raw) -> DataFrame:
    """Rated details of all runs, partitioned by run."""
    from ..operators.rating import rebate_details

    def build():
        return rebate_details(t, runs=t.soadate).selectExpr("*", "cast(docentry % 3 as int) as stat")
    return staged(t._spark, t._scope, "rebate_details", build, "genid")


@recipe
def rbdets(t, raw) -> DataFrame:
    return t.rac_rbdetailstrans.selectExpr(
        "docentry", "u_paycode", "u_labno", "cardcode", "whscode", "recondate", "u_doctorcode",
        "groupcode", "rebatesamnt as rebate", "comtype", "if(docentry % 20 = 0, 1, 0) as isexcluded",
        "if(docentry % 10 = 0, 1, 0) as isforpaymnt", "genid")


@recipe
def rac_rbpayments(t, raw) -> DataFrame:
    return raw.orders.join(never_sent(raw.customer), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey as recid", f"cast({_gen('o_orderdate')} as int) as genid",
        f"{_nn('c_nationkey')} as whscode", "concat('A', o_custkey) as pcode",
        "cast(cast(o_totalprice as decimal(18,2)) * 0.02 as decimal(18,2)) as grossrebates",
        "cast(50 as decimal(18,2)) as percentage",
        "cast(cast(o_totalprice as decimal(18,2)) * 0.01 as decimal(18,2)) as actualrebates",
        "cast(cast(o_totalprice as decimal(18,2)) * 0.01 as decimal(18,2)) as unpaidrebates",
        "if(o_orderstatus = 'O', 2, 1) as status")


@recipe
def rac_rbaginghistory(t, raw) -> DataFrame:
    paid = raw.orders.where("o_orderkey % 4 = 0")
    return paid.join(never_sent(raw.customer), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey as docid",
        f"cast(if(o_orderkey % 3 = 0, {LAST_RUN}, {_gen('o_orderdate')}) as int) as genid",
        f"{_nn('c_nationkey')} as whscode", "concat('A', o_custkey) as pcode",
        "cast(cast(o_totalprice as decimal(18,2)) * 0.01 as decimal(18,2)) as unpaidrebates",
        "cast(cast(o_totalprice as decimal(18,2)) * if(o_orderkey % 8 = 0, 0.010, 0.005)"
        " as decimal(18,2)) as amountpaid",
        "date_add(to_date(o_orderdate), 40) as paymentdate",
        "date_add(to_date(o_orderdate), cast(45 + o_orderkey % 3 as int)) as createddate")


def _aging_sums(t, name: str, build) -> DataFrame:
    """A table of sums stored by run."""
    return staged(t._spark, t._scope, name, build, "genid")


@recipe
def aging_unpaid(t, raw) -> DataFrame:
    from ..operators.aging import unpaid_sums

    return _aging_sums(t, "aging_unpaid", lambda: unpaid_sums(t.rac_rbpayments))


@recipe
def aging_settled(t, raw) -> DataFrame:
    from ..operators.aging import settled_sums

    return _aging_sums(t, "aging_settled", lambda: settled_sums(t.rac_rbaginghistory))


@recipe
def aging_current(t, raw) -> DataFrame:
    from ..operators.aging import current_sums

    return _aging_sums(t, "aging_current", lambda: current_sums(t.rac_rbpayments))


@recipe
def sales(t, raw) -> DataFrame:
    """Sales per run and branch, the input of the budget hierarchy."""
    return t.line_base.groupBy(F.expr(f"cast({_gen('docdate')} as int)").alias("genid"), "whscode").agg(
        F.sum("linetotal").cast(AMOUNT).alias("sales"))


@recipe
def rac_budgethierarchy(t, raw) -> DataFrame:
    from ..operators.budget import budget_hierarchy

    return budget_hierarchy(t.sales, t.rbdets, t.sapset).where("whscode not in ('004', '009')").drop(
        "whsname")


@recipe
def rac_rebbudgetdtl(t, raw) -> DataFrame:
    sold = (t.jdt1.join(t.oact, F.col("account") == F.col("acctcode")).where("segment_0 = '40100'")
            .join(t.ojdt, "transid")
            .groupBy(F.expr(f"cast({_gen('refdate')} as int)").alias("genid"),
                     F.col("segment_1").alias("whscode"))
            .agg(F.expr("cast(sum(credit) - sum(debit) as decimal(18,2))").alias("sales")))
    paid = t.rbdets.groupBy("genid", "whscode").agg(F.sum("rebate").cast(AMOUNT).alias("rebates"))
    return sold.join(paid, ["genid", "whscode"], "left").selectExpr(
        "genid", "whscode", "if(whscode = '003', cast(0 as decimal(18,2)), sales) as sales",
        "cast(2 as decimal(18,2)) as percnt", "cast(sales * 0.02 as decimal(18,2)) as budgetamt",
        "rebates")


@recipe
def rac_rebbudgethdr(t, raw) -> DataFrame:
    totals = t.rac_rebbudgetdtl.groupBy("genid").agg(
        F.sum("sales").cast(AMOUNT).alias("totalsales"), F.sum("rebates").cast(AMOUNT).alias("totalrebate"))
    return totals.join(t.soadate, "genid").selectExpr(
        "genid", "fdate as startdate", "tdate as enddate", "totalsales", "totalrebate")


# --- cheques and bank ---------------------------------------------------------

_CHEQNUM = "concat('1', lpad(cast(event_id as string), 9, '0'))"
_ACCT = "concat('AC', user_id % 3)"


@recipe
def rac_chequehdr(t, raw) -> DataFrame:
    return raw.events.where("event_type <> 'error'").selectExpr(
        "event_id as recid", "concat('A', user_id) as pid", "cast(value as decimal(18,2)) as payment",
        f"if(event_type = 'purchase', {_CHEQNUM}, null) as cheqnum",
        "if(event_type = 'purchase', date_add(to_date(ts), 1), null) as cheqdate",
        "cast(event_id % 2 as int) as iscrosscheq", "to_date(ts) as recdate",
        "to_date(ts) as trandate", "cast(user_id % 25 as string) as slpcode",
        "case event_type when 'purchase' then 4 when 'signup' then null else 3 end as stat",
        f"if(event_type = 'purchase', {_ACCT}, null) as acctno",
        "cast(1 + event_id % 80 as int) as genid")


@recipe
def rac_chequedtl(t, raw) -> DataFrame:
    return raw.events.where("event_type <> 'error'").selectExpr(
        "*", "explode(array(0, 1)) as part").selectExpr(
        "concat('A', user_id) as pid",
        "cast(cast(value as decimal(18,2)) * if(part = 0, 0.60, 0.40) as decimal(18,2)) as linetotal",
        f"{_nn('(user_id + part) % 25')} as whscode", "event_id as recid",
        "cast(1 + event_id % 80 as int) as genid")


@recipe
def rac_chequevoided(t, raw) -> DataFrame:
    return raw.events.where("event_type = 'error'").selectExpr(
        "event_id + 1 as tranid", "concat('A', user_id) as pid",
        "cast(value as decimal(18,2)) as payment", "concat('9', event_id) as cheqnum",
        "to_date(ts) as cheqdate", "cast(event_id % 2 as int) as iscrosscheq",
        "cast(user_id % 25 as string) as slpcode", "cast(1 + event_id % 2 as string) as voidtype",
        "concat('VOID ', event_id % 10) as remarks", "concat('U', user_id % 5) as voidedby",
        f"{_ACCT} as acctno")


@recipe
def checkbook(t, raw) -> DataFrame:
    return raw.events.selectExpr("cast(user_id % 3 as int) as id").distinct().selectExpr(
        "id", "concat('1', id) as minchk", "concat('9', id) as maxchk", "'OA' as acctype",
        "'011' as whscode", "if(id = 2, 'Payroll', 'Rebates') as chktype",
        "concat('AC', id) as acctno")


@recipe
def checkbookdtl(t, raw) -> DataFrame:
    return raw.events.where("event_type <> 'error'").selectExpr(
        "cast(user_id % 3 as int) as id", f"{_CHEQNUM} as chknum", "cast(null as string) as opnum",
        "if(event_type = 'purchase', 1, 0) as stat", "cast(null as string) as remarks")


@recipe
def passbook(t, raw) -> DataFrame:
    return raw.events.where("event_type = 'purchase' and event_id % 3 <> 0").selectExpr(
        f"{_ACCT} as acctno", f"{_CHEQNUM} as chknum", "date_add(to_date(ts), 3) as chkdate",
        "cast(value as decimal(18,2)) as credit",
        "cast(if(event_id % 3 = 1, 0, 1) as decimal(18,2)) as debit")


@recipe
def journal_hdr(t, raw) -> DataFrame:
    return raw.events.where("event_type = 'purchase'").selectExpr(
        "event_id as docentry", "if(event_id % 4 = 0, event_id, null) as transid",
        "concat('PAYEE ', user_id) as benefname", f"{_CHEQNUM} as chknum", "to_date(ts) as chkdate",
        "case when event_id % 5 = 0 then null when event_id % 7 = 0 then date'1900-01-02'"
        " else date_add(to_date(ts), 3) end as cleardate",
        f"{_ACCT} as acctno")


@recipe
def journal_dtl(t, raw) -> DataFrame:
    return raw.events.where("event_type = 'purchase'").selectExpr(
        "event_id as docentry", f"{_nn('user_id % 25')} as whscode",
        "cast(value as decimal(18,2)) as amt")


@recipe
def bank(t, raw) -> DataFrame:
    return t.checkbook.where("id <> 2").selectExpr("acctno", "concat('B', id) as bankcode")


# --- code tables and schemes ----------------------------------------------------

@recipe
def opyt(t, raw) -> DataFrame:
    return raw.orders.select("o_orderpriority").distinct().selectExpr(
        "left(o_orderpriority, 1) as u_paycode", "substr(o_orderpriority, 3) as u_paydesc")


@recipe
def accttype(t, raw) -> DataFrame:
    return raw.customer.selectExpr(
        "lpad(cast(1 + c_custkey % 7 as string), 2, '0') as acctcode").distinct().selectExpr(
        "acctcode", "concat('TYPE ', acctcode) as acctname")


@recipe
def rbpaytype(t, raw) -> DataFrame:
    return raw.customer.selectExpr("lower(c_mktsegment) as paydesc")


@recipe
def rac_rebschemehdr(t, raw) -> DataFrame:
    return raw.nation.where("n_nationkey % 3 = 0").selectExpr(
        "cast(n_nationkey as bigint) as schemecode", "concat('SCHEME ', n_name) as schemedesc",
        f"{_nn('n_nationkey')} as whscode", "if(n_nationkey % 9 = 6, 0, 1) as stat")


@recipe
def rac_rebschemedtl(t, raw) -> DataFrame:
    return t.rac_rebschemehdr.selectExpr("*", "explode(sequence(0, 4)) as c").selectExpr(
        "schemecode", "cast(c as bigint) as criteriacode", "cast(c + 1 as decimal(18,2)) as cash",
        "cast(c as decimal(18,2)) as creditcard", "if(c = 4, 0, 1) as stat")


@recipe
def rac_rebschemecriteria(t, raw) -> DataFrame:
    return raw.region.selectExpr(
        "cast(r_regionkey as bigint) as criteriacode", "concat('CRITERIA ', r_name) as criteriadesc",
        "if(r_regionkey = 3, 0, 1) as stat")
