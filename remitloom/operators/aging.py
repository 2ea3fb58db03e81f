"""Aging of unpaid rebates and payments against it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import AGE_LABELS, aging_bucket_pivot
from ..functions.dates import day
from ..functions.money import or_zero, total
from ..functions.text import optional
from .skew import never_sent


class DaySums(NamedTuple):
    """What ageing needs of payments and of what was paid on them, a row for each run, payee, branch (and days).

    A store keeps the three tables by run: a new run adds its partition
    (``store.replace_partitions``), no other changes, and any ``as_of`` only
    classes the sums anew.
    """

    unpaid: DataFrame
    settled: DataFrame
    current: DataFrame


KEYS = ["genid", "pcode", "whscode"]


def unpaid_sums(payments: DataFrame) -> DataFrame:
    """Open amounts per run, payee and branch."""
    rows = payments.where("status = 2 and coalesce(unpaidrebates, 0) <> 0")
    return rows.groupBy(*KEYS).agg(total("unpaidrebates").alias("unpaid"))


def settled_sums(history: DataFrame) -> DataFrame:
    """Amounts paid per run, payee, branch and days between payment and record."""
    days = F.abs(F.datediff("paymentdate", "createddate")).alias("days")
    return history.groupBy(*KEYS, days).agg(total("amountpaid").alias("settled"))


def current_sums(payments: DataFrame) -> DataFrame:
    """Rebates of the run itself per payee and branch."""
    return payments.where("status = 1 and actualrebates <> 0").groupBy(*KEYS).agg(total("actualrebates").alias("actualrebates"))


def day_sums(payments: DataFrame, history: DataFrame) -> DaySums:
    return DaySums(unpaid_sums(payments), settled_sums(history), current_sums(payments))


def _latest(runs: DataFrame):
    return runs.where("paymentdate is null").agg(F.max("genid").alias("g")).scalar()


def _unpaid(sums: DaySums, runs: DataFrame, as_of, keys: list[str]) -> DataFrame:
    """Unpaid amounts per keys and days from the payment date of the run (absolute)."""
    dates = runs.select("genid", F.col("paymentdate").alias("paydate"))
    return sums.unpaid.join(dates, "genid", "left").groupBy(*keys, F.datediff("paydate", day(as_of)).alias("_d")).agg(
        total("unpaid").alias("unpaid")).withColumn("nodays", F.abs("_d")).drop("_d")


def _settled(sums: DaySums, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Payments of the latest unpaid run per keys and days; keys may repeat, once per day count."""
    return sums.settled.where(F.col("genid") == _latest(runs)).groupBy(*keys, "days").agg(total("settled").alias("settled")).drop("days")


def _current(sums: DaySums, runs: DataFrame, keys: list[str]) -> DataFrame:
    return sums.current.where(F.col("genid") == _latest(runs)).groupBy(*keys).agg(total("actualrebates").alias("actualrebates"))


def _net(sums, runs, as_of, keys) -> DataFrame:
    """Unpaid less settled.  The whole settled amount of a key is taken from each of its day groups."""
    return _unpaid(sums, runs, as_of, keys).join(_settled(sums, runs, keys), keys, "left").select(
        *keys, "nodays", or_zero("settled").alias("amountpaid"),
        (or_zero("unpaid") - or_zero("settled")).cast("decimal(18,2)").alias("unpaid"))


def _total_of_classes():
    columns = [or_zero(c) for c in AGE_LABELS]
    return sum(columns[1:], columns[0]).cast("decimal(18,2)")


def aging_by_branch(payments: DataFrame, history: DataFrame, runs: DataFrame, branches: DataFrame, budget: DataFrame,
                    as_of, collapse_days: bool = False) -> DataFrame:
    """Aged amounts per branch and day count, next to budget and current rebates of the latest unpaid run."""
    return aging_by_branch_of(day_sums(payments, history), runs, branches, budget, as_of, collapse_days)


def aging_by_branch_of(stored: DaySums, runs: DataFrame, branches: DataFrame, budget: DataFrame, as_of, collapse_days: bool = False) -> DataFrame:
    """``aging_by_branch`` from sums at hand; no payment is read."""
    sums = _net(stored, runs, as_of, ["whscode"]).groupBy("whscode", "nodays").agg(
        total("amountpaid").alias("amountpaid"), total("unpaid").alias("unpaid"))
    plan = budget.where(F.col("genid") == _latest(runs)).select("whscode", "budgetamnt")
    names = branches.select(F.col("code").alias("whscode"), "whsname")
    rows = (sums.join(names, "whscode", "left").join(_current(stored, runs, ["whscode"]), "whscode", "left")
            .join(plan, "whscode", "left"))
    facts = ["whscode", "whsname", "budgetamnt", "actualrebates"]
    if collapse_days:
        paid = rows.groupBy("whscode").agg(total("amountpaid").alias("amountpaid"))
        wide = aging_bucket_pivot(rows, "nodays", "unpaid", facts).join(paid, "whscode")
    else:
        wide = aging_bucket_pivot(rows, "nodays", "unpaid", [*facts, "amountpaid", "nodays"])
    return wide.select("whscode", "whsname", F.col("amountpaid").alias("totamnttopay"),
                       or_zero("budgetamnt").alias("budgetamnt"), or_zero("actualrebates").alias("currrebs"),
                       F.lit(0).cast("decimal(18,2)").alias("totexcess"),
                       *[or_zero(c).alias(c.lower()) for c in AGE_LABELS], _total_of_classes().alias("totalaging"))


def aging_by_payee(payments: DataFrame, history: DataFrame, runs: DataFrame, payees: DataFrame, as_of) -> DataFrame:
    """The same per payee and branch; ``stat`` is 1 where something was settled."""
    return aging_by_payee_of(day_sums(payments, history), runs, payees, as_of)


def aging_by_payee_of(stored: DaySums, runs: DataFrame, payees: DataFrame, as_of) -> DataFrame:
    """``aging_by_payee`` from sums at hand; no payment is read."""
    keys = ["pcode", "whscode"]
    net = _net(stored, runs, as_of, keys).withColumn("stat", F.when(F.col("amountpaid") > 0, 1).otherwise(0))
    sums = net.groupBy(*keys, "nodays", "stat").agg(total("amountpaid").alias("amountpaid"),
                                                    total("unpaid").alias("unpaid"))
    who = payees.select(F.col("pid").alias("pcode"), "pname", "class", "add1", "hosp", "actype")
    rows = sums.join(_current(stored, runs, keys), keys, "left").join(never_sent(who), "pcode", "left")
    wide = aging_bucket_pivot(rows, "nodays", "unpaid", [*keys, "pname", "amountpaid", "actualrebates", "nodays",
                                                         "class", "add1", "hosp", "actype", "stat"])
    return wide.select("pcode", "pname", "whscode", F.col("amountpaid").alias("amnttopay"),
                       or_zero("actualrebates").alias("currrebs"), _total_of_classes().alias("totagingdets"),
                       *[or_zero(c).alias(c.lower()) for c in AGE_LABELS], "class", "add1", "hosp", "actype", "stat")


def aging_open_items(payments: DataFrame, runs: DataFrame, payee=None, branch=None) -> DataFrame:
    """Open items, oldest payment date first."""
    rows = optional(payments.where("status = 2"), pcode=payee, whscode=branch)
    return rows.join(runs.select("genid", "paymentdate"), "genid", "left").select(
        "recid", "genid", "whscode", "pcode", "unpaidrebates", F.lit(0).cast("decimal(18,2)").alias("amnttopay"),
        "paymentdate").orderBy("paymentdate", "genid", "recid")  # no date holds more than one key of the sort


class Settlement(NamedTuple):
    payments: DataFrame
    history: DataFrame


def aging_apply_payment(payments: DataFrame, history: DataFrame, batch: DataFrame, user: str, as_of) -> Settlement:
    """Record payments and close the items they cover exactly."""
    added = batch.select("docid", "genid", "whscode", "pcode", "unpaidrebates", "amountpaid", "paymentdate",
                         F.lit(user).alias("createdby"), day(as_of).alias("createddate"))
    covered = batch.select(F.col("docid").alias("recid"), F.col("amountpaid").alias("unpaidrebates"),
                           F.lit(1).alias("_closed")).distinct()
    closed = payments.join(covered, ["recid", "unpaidrebates"], "left").select(
        *[F.coalesce("_closed", "status").alias(c) if c == "status" else F.col(c) for c in payments.columns])
    return Settlement(closed, history.unionByName(added, allowMissingColumns=True))
