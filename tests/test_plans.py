"""What the plans must look like to hold at scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from remitloom.operators import rating
from remitloom.sources.bindings import bind

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_run_filter_prunes_partitions(spark):
    t = bind(spark, SF)
    plan = physical(t.rac_rbdetailstrans.where("genid = 12").groupBy("u_paycode").agg(F.sum("rebatesamnt")))
    assert re.search(r"PartitionFilters: \[.*genid.*= 12", plan)
    assert "cardcode" not in re.search(r"ReadSchema: .*", plan).group(0)


def test_date_range_reaches_the_scan(spark):
    t = bind(spark, SF)
    lines = rating.rebate_eligible_lines(t.oinv, t.inv1, t.ocrd_ext, t.ocrd, t.rac_rebprclvlmntnce, "1996-01-01",
                                         "1996-01-31", gen_id=13)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(recondate,1996-01-01\)", physical(lines))


def test_hot_account_is_split(spark):
    """One account holds a third of the rows: its join partition is divided over several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lines = spark.range(60000, numPartitions=8).selectExpr(
            "id as docentry", "if(id % 3 = 0, 'HOT', concat('C', id % 500)) as cardcode", "uuid() as note")
        masters = spark.range(500).selectExpr("concat('C', id) as cardcode", "id as rate").union(
            spark.sql("select 'HOT', 1L"))
        joined = lines.join(masters, "cardcode").groupBy("rate").agg(F.max("note").alias("n"))
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def large_tables(spark):
    """Only tables up to 100 kB are broadcast, as if the others were large."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "100k")
    yield
    for key in keys:
        spark.conf.unset(key)


def test_rating_methods_stay_compilable(spark, large_tables):
    """The JVM leaves methods above 8,000 bytes of byte code uncompiled."""
    t = bind(spark, SF)
    execution = rating.unflagged_details(t, runs=t.soadate)._jdf.queryExecution()
    execution.toRdd().count()
    text = spark._jvm.PythonSQLUtils.explainString(execution, "codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000, max(sizes)


def test_line_table_moves_once_per_key_group(spark, large_tables):
    """Once they carry their account, lines move by item and branch and by rate key, never per join."""
    t = bind(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3k")
    execution = rating.rated_lines(t, runs=t.soadate)._jdf.queryExecution()
    text = spark._jvm.PythonSQLUtils.explainString(execution, "formatted")
    moves = []
    for columns, keys in re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((.*?), \d+\)", text):
        if "linenum#" in columns and "groupcode#" in columns:
            moves.append(re.sub(r"#\d+L?", "", keys))
    assert sorted(moves) in (["groupcode, ratecomb", "itemcode, whscode"], ["itemcode, whscode"]), moves


@pytest.fixture
def small_pieces(spark):
    """Every join shuffles and nothing but the operators' own slices divides a key."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1",
                "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
                "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def largest_share(df) -> float:
    """The part of the rows that the fullest task of the last stage holds."""
    # the hash keeps columns that nothing else reads, and with them their join
    tasks = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max(F.hash(*df.columns)).alias("all"))
    sizes = [r.n for r in tasks.collect()]
    return max(sizes) / sum(sizes)


def hot_lines(spark):
    """Lines of which one account holds a third and one clinician a third, with their shares."""
    lines = spark.range(30000, numPartitions=8).selectExpr(
        "id as docentry", "1 as linenum", "if(id % 3 = 0, 100, 102) as groupcode", "if(id % 3 = 0, 'HOT', concat('C', id % 500)) as cardcode",
        "if(id % 3 = 1, 'DOC', concat('D', id % 700)) as u_doctorcode", "5 as rate", "0 as amt")
    accounts = spark.sql("select 'HOT' as cardcode union all select concat('C', id) from range(500)")
    clinicians = spark.sql("select 'DOC' as dcode union all select concat('D', id) from range(700)")
    codes = accounts.toDF("code").union(clinicians).selectExpr("code", "explode(array('-1', '-2')) as s")
    payees = codes.selectExpr("code", "concat(code, s) as pid", "code as pname")
    return lines, accounts, clinicians, payees, payees.selectExpr("code", "pid", "50 as rate", "0 as fund")


def test_hot_holders_of_the_payee_split_are_dealt_out(spark, small_pieces):
    lines, accounts, clinicians, payees, sharing = hot_lines(spark)
    heavy = rating.heavy_holders(lines, lines, 500)
    counted = {r.key: r.slices for r in heavy.collect()}
    # 10,000 lines each; a head counts as two, and C0 to C499 and D0 to D699 stay below two slices
    assert sorted(counted.values()) == [20, 40]
    whole = rating.payee_sharing_split(lines, payees, sharing, accounts, clinicians)
    dealt = rating.payee_sharing_split(lines, payees, sharing, accounts, clinicians, heavy)
    assert dealt.columns == whole.columns
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))
    assert largest_share(whole) > 0.3 and largest_share(dealt) < 0.2


def test_hot_payee_of_the_payment_flag_is_dealt_out(spark, small_pieces):
    from remitloom.operators.banding import for_payment_flag
    t = bind(spark, SF)
    details = spark.range(20000, numPartitions=8).selectExpr(
        "1 as genid", "id as docentry", "1 as linenum", "if(id % 2 = 0, 'D1', concat('D', id % 300)) as u_paycode",
        "if(id % 2 = 0, '001', lpad(id % 25, 3, '0')) as whscode", "cast(id % 90 as decimal(18,2)) as rebatesamnt").union(
        spark.sql("select 1, 20000L, 1, null, '001', 5.00bd"))
    masters = (t.rb_payees, t.rac_payeescheme, t.rac_maintenancecode)
    whole, dealt = for_payment_flag(details, *masters), for_payment_flag(details, *masters, slice_rows=400)
    assert dealt.columns == whole.columns
    key = lambda rows: sorted(map(repr, map(tuple, rows.collect())))
    assert key(dealt) == key(whole) and dealt.count() == 20001
    assert largest_share(whole) > 0.4 and largest_share(dealt) < 0.2


def test_no_heavy_key_leaves_one_slice(spark):
    lines, accounts, clinicians, payees, sharing = hot_lines(spark)
    heavy = rating.heavy_holders(lines, lines)
    assert heavy.count() == 0
    assert rating.payee_sharing_split(lines, payees, sharing, accounts, clinicians, heavy).count() == 2 * lines.count()


def test_item_tables_are_shuffled(spark):
    """Items times branches come from an explode, which the planner takes for a small table: still none is sent to all tasks."""
    items = spark.range(40).selectExpr("cast(id as string) as imh_code", "if(id % 4 = 0, 'SP', 'A') as ti_test_grp", "'1000' as imh_billcode",
                                       "explode(sequence(0, 4)) as b").selectExpr("*", "cast(b as string) as whscode").drop("b")
    listed = spark.range(0, 40, 3).selectExpr("cast(id as string) as itemcode", "explode(array('1', '3')) as whscode", "'C1' as cardcode", "'S' as itemtype",
                                              "cast(5 as decimal(18,2)) as rate", "cast(0 as decimal(18,2)) as amt")
    lines = spark.range(200).selectExpr("id as docentry", "cast(id % 40 as string) as itemcode", "cast(id % 5 as string) as whscode", "'1' as u_paymenttyp",
                                        "0 as rbsenior", "if(id % 2 = 0, 'P1', '') as u_packageno", "'1' as pmode", "1 as prclvltype", "102 as groupcode", "'C1' as cardcode")
    special = rating.special_test_set(items, listed)
    for inhouse in (None, rating.inhouse_rates(listed)):
        keyed = rating.rate_combination_key(lines, special, items, inhouse)
        for result in (keyed, keyed.drop("ratecomb")):  # without the key nothing asks which items are special
            assert "Broadcast" not in physical(result)
        assert keyed.count() == 200


def test_lines_are_dealt_by_order_once(spark, tmp_path):
    """Line items are sorted after they were dealt, never over all that a task reads, and their heads find them in place."""
    for name, columns in {"lineitem": ["cast(id / 3 as bigint) as l_orderkey", "cast(id % 3 as int) as l_linenumber", "id as l_partkey", "id as l_suppkey",
                                       "cast(id as double) as l_extendedprice", "'N' as l_returnflag", "'O' as l_linestatus"],
                          "orders": ["id as o_orderkey", "id as o_custkey", "timestamp'1996-01-01' as o_orderdate", "'1-X' as o_orderpriority"],
                          "customer": ["id as c_custkey", "'n' as c_name", "1 as c_nationkey"]}.items():
        spark.range(300).selectExpr(*columns).write.parquet(f"{tmp_path}/{name}.parquet")
    built = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("remitloom.sources.bindings.staged", lambda s, scope, name, build, *rest: built.append(build()) or built[-1])
        lines = bind(spark, str(tmp_path)).line_base
    assert lines.count() == 300
    plan = physical(lines)
    assert plan.count("Aggregate(") == 0 or re.search(r"Aggregate[\s\S]*Exchange hashpartitioning\(l_orderkey", plan)
    assert not re.search(r"hashpartitioning\(l_orderkey#\w+, l_linenumber", plan)


def built(recipe: str, spark, folder: str):
    """What a staged recipe would write."""
    kept = {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("remitloom.sources.bindings.staged", lambda s, scope, name, build, *rest: kept.setdefault(name, build()))
        return getattr(bind(spark, folder), recipe)


@pytest.mark.parametrize("recipe", ["oinv", "line_base", "rac_rbpayments", "rac_rbaginghistory"])
def test_accounts_and_heads_are_shuffled_by_recipes(spark, recipe):
    """Files of accounts are small for what they hold: no join of theirs gathers them on the driver."""
    assert "Broadcast" not in physical(built(recipe, spark, SF))


def payees(spark, n=30):
    from remitloom.operators.banding import PAYEE_COLUMNS
    row = {c: "'x'" for c in PAYEE_COLUMNS} | {"pid": "concat('A', id)", "actype": "'ACCOUNT'", "iscrosscheck": "0", "isspecialtest": "0", "isactive": "1"}
    return spark.range(n).selectExpr(*[f"{v} as {c}" for c, v in row.items()])


def test_payees_are_shuffled(spark):
    """Banding, gate, candidates, posting and ageing join payees without sending them."""
    from remitloom.operators import aging, banding, budget, review
    who = payees(spark)
    details = spark.range(60).selectExpr("1 as genid", "id as docentry", "1 as linenum", "concat('A', id % 30) as u_paycode", "'001' as whscode", "'K' as comtype",
                                         "5.00bd as rebatesamnt", "5.00bd as rebate", "0 as isexcluded", "0 as isforpaymnt", "1 as isforpayment", "1 as stat",
                                         "date'2001-01-01' as recondate")
    bands = spark.sql("select '001' as whs, '2' as payeetype, 0bd as rangefrom, 100bd as rangeto, 80bd as percnt, 5bd as amntexclusion")
    codes = spark.sql("select 'PayeeType' as type, '2' as code, 'ACCOUNT' as `desc`")
    sums = details.groupBy("genid", "u_paycode", "whscode").agg(F.sum("rebatesamnt").alias("rebatesamnt"))
    plans = {
        "gate": (budget.rated_rows(details, who), "u_paycode"),
        "typed": (budget.rated_rows(details, who, payee_type="ACCOUNT"), "u_paycode"),
        "bands": (banding.payee_scheme_banding(sums, who, bands, codes), "u_paycode"),
        "post": (review.cheque_post(details, who, "2001-01-31").headers, "pid"),
        "post_run": (review.cheque_post_run(spark.range(30).selectExpr("1 as status", "1 as isforpayment", "2bd as actualreb", "1bd as agingreb", "concat('A', id) as u_paycode",
                                                                      "'001' as whscode", "'1' as slpcode", "1 as genid"),
                                            who, "2001-01-31").headers, "pid")}
    for name, (rows, key) in plans.items():
        assert re.search(rf"SortMergeJoin \[{key}#", physical(rows)), name
        assert rows.count() > 0, name


def test_documents_of_a_run_are_shuffled(spark):
    """A run over all invoices names as many documents as there are; nothing sends them."""
    rows, heads = (spark.range(50).selectExpr("id as docentry", "1 as linenum") for _ in range(2))
    assert "Broadcast" not in physical(rating.of_documents(rows, heads))
    assert "Broadcast" not in physical(rating.new_marks(rows.selectExpr("*", "1 as genid"), heads))


def test_credits_receipts_and_flags_are_shuffled(spark):
    """What is summed per line, case or payee grows with the lines: of all these tables only the revenue accounts are sent."""
    from remitloom.operators import banding
    lines = spark.range(60).selectExpr("id as docentry", "1 as linenum", "'001' as whscode", "'I' as itemcode", "concat('L', id) as u_labno", "5.00bd as linetotal")
    credits = spark.range(60).selectExpr("if(id % 2 = 0, id, null) as baseref", "if(id % 2 = 0, 1, null) as baseline", "concat('L', id) as u_labno", "'001' as whscode",
                                         "'I' as itemcode", "1.50bd as linetotal")
    credited = rating.credit_memo_net(lines, credits, 2)
    assert "Broadcast" not in physical(credited)
    assert sorted(str(r.cm) for r in credited.collect()) == ["1.50"] * 60
    receipts = spark.range(60).selectExpr("id as docnum", "id as docentry")
    postings = spark.range(60).selectExpr("24 as transtype", "if(id % 2 = 0, 'A1', 'A2') as account", "id as baseref")
    accounts = spark.range(2).selectExpr("if(id = 0, '40100', '50000') as segment_0", "concat('A', id + 1) as acctcode")
    heads = spark.range(60).selectExpr("id as docnum", "if(id % 3 = 0, 'Y', 'N') as canceled")
    paid = rating.installment_paid(credited, receipts.selectExpr("*", "1 as linenum", "2.00bd as linetotal"), postings, accounts, receipts, heads, 2)
    sent = re.findall(r"BroadcastExchange", physical(paid))
    assert len(sent) == 1 and re.search(r"BroadcastHashJoin \[account#\w+\], \[acctcode#", physical(paid))
    assert [str(r.ip) for r in paid.orderBy("docentry").limit(6).collect()] == ["0.00", "0.00", "2.00", "0.00", "2.00", "0.00"]
    details = spark.range(60).selectExpr("cast(id % 2 as int) as genid", "id as docentry", "1 as linenum", "concat('A', id % 30) as u_paycode",
                                         "if(id < 99, '001', '002') as whscode", "3.00bd as rebatesamnt")
    bands = spark.sql("select '001' as whs, '2' as payeetype, 0bd as rangefrom, 100bd as rangeto, 80bd as percnt, 5bd as amntexclusion")
    flagged = banding.for_payment_flag(details, payees(spark), bands, spark.sql("select 'PayeeType' as type, '2' as code, 'ACCOUNT' as `desc`"))
    assert re.search(r"SortMergeJoin \[genid#\w+, u_paycode#\w+, whscode#", physical(flagged))
    assert {r.isforpayment for r in flagged.collect()} == {1} and flagged.count() == 60


def test_lines_meet_heads_and_accounts_by_shuffle(spark):
    """The plan of the commission fact is the same at every size: its traffic grows with the lines."""
    from remitloom.operators import commission
    t = bind(spark, SF)
    assert "Broadcast" not in physical(commission.invoice_line_fact(t.oinv, t.inv1, t.rin1, t.aopdet2))
    segments = commission.account_segment(commission.invoice_line_fact(t.oinv, t.inv1, t.rin1, t.aopdet2), t.ocrd_ext, t.odrs, commission.special_item_set(t.item_masterh))
    assert re.search(r"SortMergeJoin \[cardcode#", physical(segments))


def test_commission_lines_do_not_move_for_accounts(spark, frame):
    """All of history: accounts are brought to the documents, special items are never sent; repeated rows count as before."""
    from remitloom.operators import commission
    lines = spark.range(60).selectExpr("id % 20 as docentry", "date'2001-01-01' as docdate", "'L' as labno", "cast(id % 7 as string) as itemcode", "'001' as whscode",
                                       "concat('C', id % 20 % 5) as cardcode", "'D1' as u_doctorcode", "5.00bd as amount", "1.00bd as adjamt", "0.00bd as paid",
                                       "id as linenum").repartition("docentry")
    heads = lines.select("docentry", "cardcode")  # every document three times
    accounts = frame([("C0", 100, "a", "01"), ("C1", 102, "b", "04"), ("C1", 102, "c", "04"), ("C2", 100, "d", "06"), ("C3", 100, "e", None), (None, 100, "f", "01")],
                     "cardcode string, groupcode int, address string, u_accounttype string")
    clinicians = frame([("D1", "NORTH")], "dcode string, hosp string")
    special = commission.special_item_set(frame([("1", "P", "SP"), ("1", "S", "SP"), ("1", "S", "SP"), ("2", "P", "A")], "imh_code string, imh_type string, ti_test_grp string"))
    plain, by_document = (commission.account_segment(lines, accounts, clinicians, special, h) for h in (None, heads))
    assert sorted(map(str, by_document.collect())) == sorted(map(str, plain.collect()))
    assert plain.count() == 42  # 12 lines of C0 and C1 each, C1 twice; two of each have item 1, which has two types
    plan = physical(by_document)
    assert re.search(r"SortMergeJoin \[itemcode#", plan)
    assert re.search(r"SortMergeJoin \[docentry#\w+, cardcode#", plan)
    whole = physical(commission.commission_lines(bind(spark, SF)))
    assert re.search(r"SortMergeJoin \[docentry#\w+, cardcode#", whole) and not re.search(r"Exchange hashpartitioning\(docentry#\w+, cardcode", whole)


@pytest.mark.parametrize("kind", ["all", "package", "single"])
def test_packages_and_rates_of_tests_are_shuffled(spark, kind):
    """Packages and rates stand once per item and branch by an explode, which the planner does not count: neither is sent; keys that repeat or are null meet as before."""
    from remitloom.operators import masters
    branch = "explode(array('001', '002', null)) as whscode"
    items = spark.range(8).selectExpr("if(id = 7, null, cast(id as string)) as imh_code", "'name' as imh_desc", branch)
    packs = spark.range(10).where("id % 2 = 1").selectExpr("if(id = 7, null, cast(id as string)) as imd_pkg_code", "concat('I', id) as imd_pkg_item", branch)
    packs = packs.unionByName(packs.where("imd_pkg_code = '3'"))
    rates = spark.range(6).selectExpr("cast(id as string) as imh_code", "if(id = 1, 'other', concat('I', id)) as imd_pkg_item", branch, "cast(id as decimal(18,2)) as rate", "1.00bd as amnt")
    rates = rates.unionByName(rates.where("imh_code in ('3', '4')"))
    found = masters.test_rate_list(items, packs, rates, kind)
    assert "Broadcast" not in physical(found)
    # items 1, 3 and 5 are packages, 3 twice; rates of 3 and 4 stand twice; a null branch or code meets nothing
    whole, named, alone = [(c, w) for c in "0246" for w in ("001", "002")] + [("4", "001"), ("4", "002")], {"1": 1, "3": 4, "5": 1}, [(None, "001"), (None, "002")]
    packages = [(c, w) for c, n in named.items() for w in ("001", "002") for _ in range(n)]
    nulls = [(str(c), None) for c in range(7)] + [(None, None)]
    want = {"all": whole + packages + alone + nulls, "single": whole + alone + nulls, "package": packages}[kind]
    got = found.collect()
    assert sorted(((r.imh_code, r.whscode) for r in got), key=str) == sorted(want, key=str)
    assert {str(r.rate) for r in got if r.imh_code == "1"} == ({"1.00", "0.00"} if kind == "all" else {"0.00"})
