"""Payment bands and thresholds shared by rating, review and posting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import or_zero, percent_of, total
from ..functions.text import or_blank
from .skew import heavy_keys, never_sent, spread_join

PAYEE_COLUMNS = ["pid", "pname", "class", "acctnum", "add1", "slpcode", "hosp", "telno", "actype",
                 "periodtype", "dispatchtype", "iscrosscheck", "isspecialtest", "isactive"]


def active_payees(payees: DataFrame) -> DataFrame:
    """Distinct active payee rows, never sent whole by a join; a payee with two differing rows stays twice."""
    return never_sent(payees.where("isactive = 1").select(*PAYEE_COLUMNS).distinct())


def payee_bands(scheme: DataFrame, codes: DataFrame) -> DataFrame:
    """Bands with the payee type spelled out."""
    types = codes.where("type = 'PayeeType'").select(F.col("code").alias("payeetype"), F.col("desc").alias("band_type"))
    return scheme.withColumn("payeetype", F.col("payeetype").cast("string")).join(types, "payeetype", "left").select(
        "band_type", F.col("whs").alias("band_whs"), "rangefrom", "rangeto", "percnt", "amntexclusion")


def payee_scheme_banding(rebates: DataFrame, payees: DataFrame, scheme: DataFrame,
                         codes: DataFrame) -> DataFrame:
    """Pay percentage, exclusion threshold and payable amount per rebate total.

    ``rebates`` holds totals (genid, u_paycode, whscode, …, rebatesamnt).  The
    totals are joined, not the detail rows, and the bands carry an equality on
    branch and type next to the range.
    """
    bands = payee_bands(scheme, codes)
    ranges = bands.select("band_type", "band_whs", "rangefrom", "rangeto", "percnt")
    limits = bands.select(F.col("band_type").alias("limit_type"), F.col("band_whs").alias("limit_whs"),
                          "amntexclusion").distinct()
    joined = (
        rebates.join(active_payees(payees), F.col("pid") == F.col("u_paycode"), "left")
        .join(ranges, (F.col("band_whs") == F.col("whscode")) & (F.col("band_type") == F.col("actype"))
              & F.col("rebatesamnt").between(F.col("rangefrom"), F.col("rangeto")), "left")
        .join(limits, (F.col("limit_whs") == F.col("whscode")) & (F.col("limit_type") == F.col("actype")), "left")
    )
    percent = F.coalesce(F.col("percnt"), F.lit(Decimal("100"))).cast("decimal(18,2)")
    exclusion = or_zero("amntexclusion")
    own = [F.col(c) for c in rebates.columns if c not in ("rebatesamnt", "whscode")]
    return joined.select(
        *own, or_blank("pname").alias("pname"), or_blank("add1").alias("add1"),
        or_blank("class").alias("class"), or_blank("actype").alias("actype"),
        or_blank("periodtype").alias("periodtype"), F.col("slpcode"),
        F.trim("whscode").alias("whscode"), or_zero("rebatesamnt").alias("rebatesamnt"),
        percent.alias("percnt"), exclusion.alias("amntexclusion"),
        percent_of(or_zero("rebatesamnt"), percent).alias("actualreb"),
        F.when(F.col("rebatesamnt") >= exclusion, 1).otherwise(0).alias("payable"))


def for_payment_flag(details: DataFrame, payees: DataFrame, scheme: DataFrame, codes: DataFrame,
                     slice_rows: int | None = None) -> DataFrame:
    """Details with ``isforpayment``: the payee's branch total reaches the exclusion amount.

    Totals are aggregated map-side first; only they are banded.  A payee listed
    with several types is paid when any of them qualifies.  With ``slice_rows``
    the rows of a payee with more of them in a branch and run are dealt into
    slices, each joined to its own copy of the flag; ``details`` is read once
    more for the three columns of the key.
    """
    sums = details.groupBy("genid", "u_paycode", "whscode").agg(total("rebatesamnt").alias("rebatesamnt"))
    flags = payee_scheme_banding(sums, payees, scheme, codes).groupBy("genid", "u_paycode", "whscode").agg(
        F.max("payable").alias("isforpayment"))
    rows = details.drop("isforpayment")
    if slice_rows is not None:
        keys = ["genid", "u_paycode", "whscode"]
        return spread_join(rows, flags, {k: F.col(k) for k in keys}, ["docentry", "linenum"], heavy_keys(rows, keys, slice_rows), "left")
    return rows.join(never_sent(flags), ["genid", "u_paycode", "whscode"], "left").select(
        *[rows[c] for c in rows.columns], "isforpayment")


def budget_gate(rebates: DataFrame, criteria: DataFrame, keys: list[str], value: str = "rebate",
                passed: int = 1, failed: int = 0) -> DataFrame:
    """Totals per ``keys`` against the (branch, account type) threshold; passing needs strictly more."""
    sums = rebates.groupBy(*keys).agg(total(value).alias("rebate"))
    return gate_totals(sums, criteria, passed, failed)


def gate_totals(sums: DataFrame, criteria: DataFrame, passed: int = 1, failed: int = 0) -> DataFrame:
    """The gate for totals that are already there."""
    limits = criteria.select(F.col("whscode").alias("c_whs"), F.col("accounttype").alias("c_type"), "amntexcluded")
    limit = or_zero("amntexcluded")
    return (sums.join(limits, (F.col("c_whs") == F.col("whscode")) & (F.col("c_type") == F.col("actype")), "left")
            .select(*sums.columns, limit.alias("amntexcluded"),
                    F.when(F.col("rebate") > limit, passed).otherwise(failed).alias("budgetstat")))
