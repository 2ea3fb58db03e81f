"""SQL twins of the derived input tables, as named common table expressions.

``with_tables(sql)`` puts the tables a statement mentions (directly or through
another table) in front of it, so each registered query has one
self-contained statement over the provided tables.
"""

from __future__ import annotations

import re

_NN = "lpad(cast({0} as varchar), 3, '0')"


def nn(key: str) -> str:
    return _NN.format(key)


def gen(date: str) -> str:
    return f"((year({date}) - 1995) * 12 + month({date}))"


_DCODE = "(case when s_suppkey = 3 then '00' else 'D' || s_suppkey end)"
_HOSP = "(case s_suppkey % 4 when 0 then 'INCIDENTAL' when 1 then 'CENTRAL' when 2 then 'NORTH' end)"
_GROUP = "(case when p_type = 'PROMO' then 'SP' else p_type end)"
_CHEQNUM = "('1' || lpad(cast(event_id as varchar), 9, '0'))"
_ACCT = "('AC' || user_id % 3)"
_BR = "(select unnest(range(0, 25)) nk)"
D2 = "decimal(18,2)"

TABLES = {
    "fx_oinv": f"""select o_orderkey docentry, 'L' || o_orderkey labno, 'C' || c_custkey cardcode, c_name cardname,
        cast(o_orderdate as date) docdate, cast(o_orderdate as date) recondate, {nn('c_nationkey')} whscode,
        substr(o_orderpriority, 1, 1) pmode from orders join customer on o_custkey = c_custkey""",
    "fx_line_base": f"""select l.l_linenumber linenum, l.partkey, l.suppkey, l.linetotal, l.rf, l.ls, o.docentry, o.labno,
        o.whscode, o.docdate from (select l_orderkey, l_linenumber, min(l_partkey) partkey, min(l_suppkey) suppkey,
        cast(sum(cast(l_extendedprice as {D2})) as {D2}) linetotal, min(l_returnflag) rf, min(l_linestatus) ls
        from lineitem group by 1, 2) l join fx_oinv o on l.l_orderkey = o.docentry""",
    "fx_inv1": """select docentry, linenum, cast(partkey as varchar) itemcode, labno u_labno,
        case when linenum % 3 = 0 then 'P1' else '' end u_packageno,
        case when suppkey = 3 then '00' else 'D' || suppkey end u_doctorcode,
        cast(1 + (docentry + linenum) % 8 as varchar) u_paymenttyp,
        case when docentry % 11 = 0 then 'HP01' else 'LB01' end u_source, whscode, linetotal from fx_line_base""",
    "fx_rin1": f"""select case when ls = 'F' then docentry end baseref, case when ls = 'F' then linenum end baseline,
        labno u_labno, whscode, cast(partkey as varchar) itemcode,
        case when docentry % 7 = 0 then linetotal else cast(linetotal * 0.25 as {D2}) end linetotal
        from fx_line_base where rf = 'R'""",
    "fx_aopdet2": f"""select docentry, linenum, docentry docnum, cast(linetotal * 0.30 as {D2}) linetotal
        from fx_line_base where rf = 'A'""",
    "fx_jdt1": f"""select docentry transid, (case when partkey % 3 = 0 then '40100' else '50000' end) || '-' || whscode account,
        linetotal credit, cast(case when rf = 'R' then cast(linetotal * 0.10 as {D2}) else 0 end as {D2}) debit,
        docentry baseref, case when rf = 'A' then 24 else 13 end transtype from fx_line_base""",
    "fx_ojdt": "select o_orderkey transid, cast(o_orderdate as date) refdate from orders",
    "fx_oact": f"""select s || '-' || {nn('n_nationkey')} acctcode, s segment_0, {nn('n_nationkey')} segment_1,
        s || {nn('n_nationkey')} formatcode, (case when s = '40100' then 'SALES ' else 'OTHER ' end) || n_name acctname
        from nation, (select unnest(['40100', '50000']) s)""",
    "fx_ocrd": f"""select 'C' || c_custkey cardcode, c_name u_cardname, cast(c_custkey % 5 * 2 as {D2}) rebrates,
        case when c_custkey % 3 = 0 then 0 else 1 end rbprclvl,
        case when c_custkey % 3 = 0 then null else date '2001-12-31' end rbexpdt,
        case when c_custkey % 3 = 0 then null else date '1999-06-30' end rbdatetagged,
        case when c_custkey % 4 = 0 then 1 else 0 end rbsenior, 0 member, cast(null as int) pwd,
        case when c_custkey % 10 = 9 then 0 else 1 end isactive from customer""",
    "fx_ocrd_ext": """select 'C' || c_custkey cardcode, c_name cardname, case when c_custkey % 50 = 0 then 'S' else 'C' end cardtype,
        case when c_mktsegment in ('BUILDING', 'MACHINERY') then 100 else 102 end groupcode, 'ADDR ' || c_nationkey address,
        case when c_custkey % 97 = 0 then null else lpad(cast(1 + c_custkey % 7 as varchar), 2, '0') end u_accounttype
        from customer""",
    "fx_odrs": f"""select {_DCODE} dcode, s_name dname, {_HOSP} hosp, {nn('s_nationkey')} u_location, 'ADDR ' || s_suppkey add1,
        cast(null as varchar) sched, cast(s_nationkey as varchar) slpcode,
        case when s_suppkey % 3 = 0 then 'GP' else 'SURGEON' end specialization, 'AC' || s_suppkey % 3 acctno,
        '0' || s_suppkey phone1, cast(null as varchar) email, cast(null as varchar) remarks from supplier""",
    "fx_norebate": f"select {_DCODE} cardcode, '102' groupcode from supplier where s_suppkey % 9 = 8",
    "fx_oslp_ext": "select cast(n_nationkey as varchar) slpcode, 'REP ' || n_name slpname from nation where n_nationkey <> 24",
    "fx_oslp": f"""select cast(n_nationkey as varchar) slpcode, 'REP ' || n_name slpname,
        case when n_nationkey % 5 = 0 then null else r_name end district,
        case when n_nationkey % 3 = 0 then null else 'SENIOR' end position, cast(null as varchar) email,
        cast(n_nationkey * 10 as {D2}) incentive, case when n_nationkey % 2 = 0 then 'FIX' end comtype,
        cast(null as varchar) atm, {nn('n_nationkey')} whscode,
        case when n_nationkey % 4 = 3 then null else 'E' || n_nationkey end empid, cast(50 as {D2}) salesqualifier,
        cast(40 as {D2}) callsqualifier from nation join region on n_regionkey = r_regionkey""",
    "fx_emp": f"""select 'E' || s_suppkey empcode, 'f' || s_suppkey fname, case when s_suppkey % 6 = 0 then null else 'mid' end mname,
        'l' || s_suppkey lname, s_name empname, {nn('s_nationkey')} branchcode, case when s_suppkey % 2 = 0 then 18 else 7 end deptcode,
        case when s_suppkey % 8 = 0 then null else date '1990-01-01' + cast(s_suppkey % 3000 as int) end datehired from supplier""",
    "fx_bpslp": f"""select stype, bpcode, bpname, cast((nk + part) % 25 as varchar) slpcode,
        case when part = 0 then date '1990-01-01' else date '1998-07-01' end encodedate,
        case when part = 0 then date '1990-01-01' else date '1998-07-01' end sdate,
        case when part = 0 then date '1998-06-30' else date '2099-12-31' end edate
        from (select 100 stype, 'C' || c_custkey bpcode, c_name bpname, c_nationkey nk from customer where c_custkey % 12 <> 11
        union all select 102, {_DCODE}, s_name, s_nationkey from supplier where s_suppkey % 12 <> 11),
        (select unnest([0, 1]) part)""",
    "fx_itemh": f"""select cast(p_partkey as varchar) imh_code, p_name imh_desc, case when p_size % 2 = 1 then 'P' else 'S' end imh_type,
        case p_size when 1 then '5000' when 2 then '5010' else '1000' end imh_billcode, {_GROUP} ti_test_grp, {nn('nk')} whscode
        from part, {_BR}""",
    "fx_itemd": f"""select cast(p_partkey as varchar) imd_pkg_code, 'I' || p_partkey imd_pkg_item, {nn('nk')} whscode
        from part, {_BR} where p_size % 2 = 1""",
    "fx_spcl": f"""select cast(p_partkey as varchar) itemcode, p_name itemname, {nn('nk')} whscode,
        cast(10 + p_size % 20 + twin * 5 as {D2}) rate, cast(case when p_size % 3 = 0 then 25 else 0 end as {D2}) amt,
        case when p_partkey % 2 = 0 then '102' else '100' end grpcode, case when p_size % 2 = 1 then 'P' else 'S' end itemtype,
        case when twin = 1 then 'C1' when p_partkey % 2 = 0 then null else 'C' || p_partkey % 100 end cardcode
        from part, {_BR}, (select unnest([0, 1]) twin)
        where p_partkey % 17 = 0 and nk % 2 = 0 and (twin = 0 or p_partkey % 34 = 0)""",
    "fx_prclvl": f"select {nn('n_nationkey')} whs, 1 + n_nationkey % 3 prclvltype from nation where n_nationkey % 5 <> 4",
    "fx_pricehdr": """select 'R' || r_regionkey company, r_name || '1' price_level1, r_name || '2' price_level2,
        case when r_regionkey = 0 then null else r_name || '3' end price_level3, pricetype
        from region, (select unnest(['N', 'S']) pricetype)""",
    "fx_sapset": f"""select {nn('n_nationkey')} code, 'BRANCH ' || n_name whsname, n_name blk,
        case when n_nationkey % 10 = 9 then 'C' else 'O' end stat, case when n_nationkey % 10 = 8 then 'C' else 'O' end slsstat,
        'R' || n_regionkey lisgrp from nation""",
    "fx_testgroup": f"select distinct {_GROUP} tg_code, 'GROUP ' || {_GROUP} tg_name from part",
    "fx_ratecomb": f"""select cast(gi as bigint) * 100000000 + pm * 10000000 + pay * 1000000 + snr * 100000 + pkg * 10000 + nk ratecode,
        pm || lpad(cast(pay as varchar), 2, '0') || snr || pkg || (1 + nk % 3) || {nn('nk')} || tg_code ratedesc,
        cast(pm as varchar) pmode, lpad(cast(pay as varchar), 2, '0') accttype, cast(snr as varchar) senior,
        cast(pkg as varchar) pcktype, cast(1 + nk % 3 as varchar) prclvl, {nn('nk')} whs, tg_code testgrp,
        cast(5 + pay + pkg as {D2}) rate, cast(0 as {D2}) amount, 102 as type
        from (select tg_code, ascii(tg_code) * 100 + ascii(substr(tg_code, 2, 1)) gi from fx_testgroup),
        (select unnest([1, 2, 3, 4, 7]) pay), (select unnest([0, 1]) snr), (select unnest([0, 2, 3]) pkg),
        (select unnest([1, 2, 3, 4, 5]) pm), {_BR} where nk % 5 <> 4
        union all select cast(gi as bigint) * 100000000 + pay * 1000000 + snr * 100000 + pkg * 10000 + 99,
        lpad(cast(pay as varchar), 2, '0') || snr || pkg || tg_code, null, lpad(cast(pay as varchar), 2, '0'),
        cast(snr as varchar), cast(pkg as varchar), null, null, tg_code, cast(5 + pay + pkg as {D2}), cast(0 as {D2}), 100
        from (select tg_code, ascii(tg_code) * 100 + ascii(substr(tg_code, 2, 1)) gi from fx_testgroup),
        (select unnest([1, 2, 3, 4, 7]) pay), (select unnest([0, 1]) snr), (select unnest([0, 2, 3]) pkg)""",
    "fx_testrate": f"""select cast(p_partkey as varchar) imh_code, case when p_size % 2 = 1 then 'I' || p_partkey end imd_pkg_item,
        {nn('nk')} whscode, cast(10 + nk as {D2}) rate, cast(p_size as {D2}) amnt, 1 stat from part, {_BR} where p_partkey % 5 = 0""",
    "fx_oitm": """select cast(p_partkey as varchar) itemcode, p_name itemname,
        case when p_size % 2 = 0 then 'N' else 'Y' end invntitem from part""",
    "fx_custmaster": f"""select 'C' || c_custkey dbcode, 'F' || folder || {nn('c_nationkey')} folder_id
        from customer, (select unnest([0, 1]) folder)""",
    "fx_payees": f"""select {_DCODE} || sfx pid, {_DCODE} code, case when sfx = '' then s_name else s_name || ' SEC' end pname,
        case when sfx = '' then 'Clinician' else 'Secretary' end class, 'AC' || s_suppkey acctnum,
        case when s_suppkey % 6 = 0 then null else 'ADDR ' || s_suppkey end add1, cast(s_nationkey as varchar) slpcode, {_HOSP} hosp,
        cast(null as varchar) telno, 'CLINICIAN' actype, 'MONTHLY' periodtype,
        case when s_suppkey % 3 = 0 then null else 'PICKUP' end dispatchtype,
        case when s_suppkey % 7 = 0 then null else cast(s_suppkey % 2 as int) end iscrosscheck, 0 isspecialtest,
        case when s_suppkey % 10 = 9 then 0 else 1 end isactive
        from supplier, (select unnest(['', '-S']) sfx) where sfx = '' or s_suppkey % 5 = 0
        union all select 'A' || c_custkey, 'C' || c_custkey, c_name, 'Account', 'AC' || c_custkey,
        case when c_custkey % 6 = 0 then null else 'ADDR ' || c_custkey end, cast(c_nationkey as varchar), null, null, 'ACCOUNT',
        'QUARTERLY', case when c_custkey % 3 = 0 then null else 'MAIL' end,
        case when c_custkey % 7 = 0 then null else cast(c_custkey % 2 as int) end, 1,
        case when c_custkey % 10 = 9 then 0 else 1 end from customer""",
    "fx_sharing": f"""select {_DCODE} code, {_DCODE} || sfx pid,
        cast(case when sfx = '-S' then 20 when s_suppkey % 5 = 0 then 80 else 100 end as {D2}) rate,
        cast(case when sfx = '' and s_suppkey % 4 = 0 then 5 else 0 end as {D2}) fund
        from supplier, (select unnest(['', '-S']) sfx) where sfx = '' or s_suppkey % 5 = 0
        union all select 'C' || c_custkey, 'A' || c_custkey, cast(100 as {D2}),
        cast(case when c_custkey % 4 = 0 then 5 else 0 end as {D2}) from customer""",
    "fx_oacs1": f"""select {_DCODE} code, nk + 1 lineid, {_DCODE} u_paycode, s_name u_payname, {nn('nk')} u_branch,
        'NATION_' || nk u_bname, 'Clinician' u_class, 'AC' || s_suppkey u_acntno, cast(100 as {D2}) u_share
        from supplier, {_BR} where s_suppkey % 2 = 0 and nk < 20""",
    "fx_scheme": f"""select linenum, payeetype, {nn('n_nationkey')} whs,
        cast(case when linenum = 1 then 0 else 10000 end as {D2}) rangefrom,
        cast(case when linenum = 1 then 9999.99 else 9999999 end as {D2}) rangeto,
        cast(case when linenum = 1 then 80 else 100 end as {D2}) percnt, cast(500 as {D2}) amntexclusion
        from nation, (select unnest([1, 2]) payeetype), (select unnest([1, 2]) linenum) where n_nationkey % 6 <> 5""",
    "fx_codes": """select * from (values
        (1, 'RebatesPayee', 'PayeeType', 'PayeeType', '1', 'CLINICIAN', 1), (2, 'RebatesPayee', 'PayeeType', 'PayeeType', '2', 'ACCOUNT', 1),
        (3, 'Cheque Monitoring', 'VoidType', 'VoidType', '1', 'CANCELLED', 1), (4, 'Cheque Monitoring', 'VoidType', 'VoidType', '2', 'STALED', 1),
        (5, 'RebRateMntnce', 'Discount', 'Senior', '0', 'REGULAR', 1), (6, 'RebRateMntnce', 'Discount', 'Senior', '1', 'SENIOR', 1),
        (7, 'RebRateMntnce', 'Package', 'Package', '0', 'NO PACKAGE', 1), (8, 'RebRateMntnce', 'Package', 'Package', '2', 'NORMAL', 1),
        (9, 'RebRateMntnce', 'Package', 'Package', '3', 'SPECIAL', 1), (10, 'RebRateMntnce', 'PrcLvl', 'PrcLvlType', '1', 'LEVEL A', 1),
        (11, 'RebRateMntnce', 'PrcLvl', 'PrcLvlType', '2', 'LEVEL B', 1)) v(recid, module, ctype, cgroup, code, descr, isactive)""",
    "fx_criteria": f"""select a accounttype, {nn('n_nationkey')} whscode, cast(1000 as {D2}) amntexcluded
        from nation, (select unnest(['CLINICIAN', 'ACCOUNT']) a) where n_nationkey % 7 <> 6""",
    "fx_months": "select distinct cast(date_trunc('month', o_orderdate) as date) fdate from orders",
    "fx_soadate": f"""select {gen('fdate')} genid, fdate, last_day(fdate) tdate, last_day(fdate) asofdate,
        case when {gen('fdate')} <= 76 then last_day(fdate) + 15 end paymentdate from fx_months""",
    "fx_schedule": """select genid, cast(strftime(fdate, '%Y%m%d') as int) schedstartdate, cast(strftime(tdate, '%Y%m%d') as int) schedenddate,
        lpad(cast(genid % 24 as varchar), 2, '0') || '3000' schedstarttime, genid % 2 isenabled from fx_soadate""",
    "fx_calendar": "select year(fdate) yr, month(fdate) pd from fx_soadate",
    "fx_qualifiers": f"""select cast(nk as varchar) slpcode, pd as mm, yr as yy, cast(50 + (nk + pd) % 50 as {D2}) salesqualifier,
        cast(40 + nk % 60 as {D2}) callsqualifier, cast(90 - nk as {D2}) callsperformance from fx_calendar, {_BR} where nk % 8 <> 7""",
    "fx_targets": f"""select cast(nk as varchar) slpcode, yr, pd, cast(100000 + 1000 * nk as {D2}) amt
        from fx_calendar, {_BR} where nk % 8 <> 7""",
    "fx_commhdr": """select r_regionkey schemecode, make_date(1995 + r_regionkey, 1, 1) datestarted,
        case when r_regionkey = 4 then null else make_date(1996 + r_regionkey, 6, 30) end dateended from region""",
    "fx_commdtl": f"""select n_regionkey schemecode, cast(n_nationkey * 10000 as {D2}) amtfr,
        cast(n_nationkey * 10000 + 9999.99 as {D2}) amtto, cast(1 + n_nationkey % 5 as {D2}) prcnt,
        case when n_nationkey % 4 = 0 then 'MISSION' else 'REGULAR' end commtype, n_nationkey orderby,
        case when n_nationkey % 6 = 5 then 1 else 0 end isdeleted from nation""",
    "fx_payments": f"""select o_orderkey recid, {gen('o_orderdate')} genid, {nn('c_nationkey')} whscode, 'A' || o_custkey pcode,
        cast(cast(o_totalprice as {D2}) * 0.02 as {D2}) grossrebates, cast(50 as {D2}) percentage,
        cast(cast(o_totalprice as {D2}) * 0.01 as {D2}) actualrebates, cast(cast(o_totalprice as {D2}) * 0.01 as {D2}) unpaidrebates,
        case when o_orderstatus = 'O' then 2 else 1 end status from orders join customer on o_custkey = c_custkey""",
    "fx_history": f"""select o_orderkey docid, case when o_orderkey % 3 = 0 then 80 else {gen('o_orderdate')} end genid,
        {nn('c_nationkey')} whscode, 'A' || o_custkey pcode, cast(cast(o_totalprice as {D2}) * 0.01 as {D2}) unpaidrebates,
        case when o_orderkey % 8 = 0 then cast(cast(o_totalprice as {D2}) * 0.010 as {D2})
        else cast(cast(o_totalprice as {D2}) * 0.005 as {D2}) end amountpaid,
        cast(o_orderdate as date) + 40 paymentdate, cast(o_orderdate as date) + cast(45 + o_orderkey % 3 as int) createddate
        from orders join customer on o_custkey = c_custkey where o_orderkey % 4 = 0""",
    "fx_sales": f"select {gen('docdate')} genid, whscode, cast(sum(linetotal) as {D2}) sales from fx_line_base group by 1, 2",
    "fx_cheques": f"""select event_id recid, 'A' || user_id pid, cast(value as {D2}) payment,
        case when event_type = 'purchase' then {_CHEQNUM} end cheqnum,
        case when event_type = 'purchase' then cast(ts as date) + 1 end cheqdate, cast(event_id % 2 as int) iscrosscheq,
        cast(ts as date) recdate, cast(ts as date) trandate, cast(user_id % 25 as varchar) slpcode,
        case event_type when 'purchase' then 4 when 'signup' then null else 3 end stat,
        case when event_type = 'purchase' then {_ACCT} end acctno, cast(1 + event_id % 80 as int) genid
        from events where event_type <> 'error'""",
    "fx_chequedtl": f"""select 'A' || user_id pid, case when part = 0 then cast(cast(value as {D2}) * 0.60 as {D2})
        else cast(cast(value as {D2}) * 0.40 as {D2}) end linetotal, {nn('(user_id + part) % 25')} whscode, event_id recid,
        cast(1 + event_id % 80 as int) genid from events, (select unnest([0, 1]) part) where event_type <> 'error'""",
    "fx_voids": f"""select event_id + 1 tranid, 'A' || user_id pid, cast(value as {D2}) payment, '9' || event_id cheqnum,
        cast(ts as date) cheqdate, cast(event_id % 2 as int) iscrosscheq, cast(user_id % 25 as varchar) slpcode,
        cast(1 + event_id % 2 as varchar) voidtype, 'VOID ' || event_id % 10 remarks, 'U' || user_id % 5 voidedby, {_ACCT} acctno
        from events where event_type = 'error'""",
    "fx_book": """select distinct cast(user_id % 3 as int) id, '1' || user_id % 3 minchk, '9' || user_id % 3 maxchk, 'OA' acctype,
        '011' whscode, case when user_id % 3 = 2 then 'Payroll' else 'Rebates' end chktype, 'AC' || user_id % 3 acctno from events""",
    "fx_bookdtl": f"""select cast(user_id % 3 as int) id, {_CHEQNUM} chknum, cast(null as varchar) opnum,
        case when event_type = 'purchase' then 1 else 0 end stat, cast(null as varchar) remarks from events where event_type <> 'error'""",
    "fx_passbook": f"""select {_ACCT} acctno, {_CHEQNUM} chknum, cast(ts as date) + 3 chkdate, cast(value as {D2}) credit,
        cast(case when event_id % 3 = 1 then 0 else 1 end as {D2}) debit from events
        where event_type = 'purchase' and event_id % 3 <> 0""",
    "fx_journal": f"""select event_id docentry, case when event_id % 4 = 0 then event_id end transid, 'PAYEE ' || user_id benefname,
        {_CHEQNUM} chknum, cast(ts as date) chkdate, case when event_id % 5 = 0 then null when event_id % 7 = 0 then date '1900-01-02'
        else cast(ts as date) + 3 end cleardate, {_ACCT} acctno from events where event_type = 'purchase'""",
    "fx_journaldtl": f"""select event_id docentry, {nn('user_id % 25')} whscode, cast(value as {D2}) amt from events
        where event_type = 'purchase'""",
    "fx_bank": "select acctno, 'B' || id bankcode from fx_book where id <> 2",
    "fx_opyt": "select distinct substr(o_orderpriority, 1, 1) u_paycode, substr(o_orderpriority, 3) u_paydesc from orders",
    "fx_accttype": """select distinct lpad(cast(1 + c_custkey % 7 as varchar), 2, '0') acctcode,
        'TYPE ' || lpad(cast(1 + c_custkey % 7 as varchar), 2, '0') acctname from customer""",
    "fx_schemehdr": f"""select cast(n_nationkey as bigint) schemecode, 'SCHEME ' || n_name schemedesc, {nn('n_nationkey')} whscode,
        case when n_nationkey % 9 = 6 then 0 else 1 end stat from nation where n_nationkey % 3 = 0""",
    "fx_schemedtl": f"""select schemecode, cast(c as bigint) criteriacode, cast(c + 1 as {D2}) cash, cast(c as {D2}) creditcard,
        case when c = 4 then 0 else 1 end stat from fx_schemehdr, (select unnest(range(0, 5)) c)""",
    "fx_schemecrit": """select cast(r_regionkey as bigint) criteriacode, 'CRITERIA ' || r_name criteriadesc,
        case when r_regionkey = 3 then 0 else 1 end stat from region""",
}

_NAME = re.compile(r"\b(?:fx|st)_[a-z0-9_]+\b")


def with_tables(sql: str) -> str:
    """The statement with every table expression it needs in front, in dependency order."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in TABLES and name not in ordered:
                need(TABLES[name])
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    if not ordered:
        return sql
    return "with " + ",\n".join(f"{n} as ({TABLES[n]})" for n in ordered) + "\n" + sql
