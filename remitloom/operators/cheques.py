"""Cheques: monitoring lists, numbering, voiding and the match with the bank."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import UNCLEARED, day, month_start
from ..functions.money import or_zero, total
from ..functions.text import optional, or_blank
from .banding import active_payees
from .keyed import keyed_update

# Cheque states, void reasons and the payment branch.
PENDING, PROCESSED = 3, 4
CANCELLED, STALED = "1", "2"
BOOK_TYPE, BOOK_BRANCH, BOOK_USE = "OA", "011", "Rebates"
BANK_SUFFIX = "011000"


def in_month(rows: DataFrame, month, column: str = "trandate") -> DataFrame:
    """Rows dated in the month of ``month``; a range on the plain column reaches the scan."""
    if month is None:
        return rows
    first = month_start(day(month))
    return rows.where((F.col(column) >= first) & (F.col(column) < F.add_months(first, 1)))


def _with_payee(cheques: DataFrame, payees: DataFrame, reps: DataFrame) -> DataFrame:
    """Cheques with their active payee (left) and the payee's rep (left)."""
    who = active_payees(payees).select("pid", "pname", "add1", F.col("slpcode").alias("p_rep"))
    names = reps.select(F.col("slpcode").alias("r_rep"), "slpname")
    return cheques.join(who, "pid", "left").join(names, F.col("r_rep") == F.col("p_rep"), "left")


def cheque_progress_by_rep(cheques: DataFrame, payees: DataFrame, reps: DataFrame, month=None) -> DataFrame:
    """'processed / total' per rep.  Equal cheques count once; a payee listed twice counts twice."""
    rows = _with_payee(in_month(cheques, month), payees, reps)
    once = rows.groupBy("pid", "pname", "cheqnum", "cheqdate", "iscrosscheq", "trandate", "r_rep", "slpname", "stat",
                        "acctno", "genid").agg(F.count(F.lit(1)).alias("_n"))
    listed = active_payees(payees).select("pid")
    counts = once.join(listed, "pid", "left").groupBy(F.col("r_rep").alias("slpcode"), "slpname").agg(
        F.count(F.when(F.col("stat") == PROCESSED, 1)).alias("done"), F.count("pid").alias("all"))
    text = F.concat(F.col("done").cast("string"), F.lit(" / "), F.col("all").cast("string"))
    return counts.select("slpcode", F.upper("slpname").alias("slpname"), text.alias("total"))


def cheque_month_list(cheques: DataFrame, payees: DataFrame, reps: DataFrame, rep_code=None, month=None) -> DataFrame:
    """Cheques of the month, of one rep or of all payees with a rep."""
    rows = optional(_with_payee(in_month(cheques, month), payees, reps).where("r_rep is not null"), r_rep=rep_code)
    keys = ["cheqnum", "pid", "pname", "cheqdate", "iscrosscheq", "add1", "stat", "genid", "acctno"]
    return rows.groupBy(*keys).agg(total("payment").alias("payment")).select(
        or_blank("cheqnum").alias("cheqnum"), or_blank("pid").alias("pid"), or_blank(F.upper("pname")).alias("pname"),
        or_zero("payment").alias("payment"), "cheqdate", F.coalesce("iscrosscheq", F.lit(0)).alias("iscrosscheq"),
        or_blank("add1").alias("add1"), F.coalesce("stat", F.lit(PENDING)).alias("stat"), "genid", "acctno")


def cheque_status_list(cheques: DataFrame, payees: DataFrame, reps: DataFrame, stat: int, month=None) -> DataFrame:
    """Processed (4) or pending (3, which includes cheques without a state) cheques of the month."""
    rows = _with_payee(in_month(cheques, month).where(F.coalesce("stat", F.lit(PENDING)) == stat), payees, reps)
    keys = ["cheqnum", "pid", "pname", "cheqdate", "iscrosscheq", "add1", "slpname", "slpcode", "genid"]
    return rows.groupBy(*keys).agg(total("payment").alias("payment")).select(
        or_blank("cheqnum").alias("cheqnum"), or_blank("pid").alias("pid"), or_blank(F.upper("pname")).alias("pname"),
        or_zero("payment").alias("payment"), "cheqdate", F.coalesce("iscrosscheq", F.lit(0)).alias("iscrosscheq"),
        or_blank("add1").alias("add1"), "slpname", "slpcode", "genid")


def cheque_void_list(voids: DataFrame, cheques: DataFrame, payees: DataFrame, reps: DataFrame, codes: DataFrame,
                     month=None) -> DataFrame:
    """Voided cheques with the number issued instead and the reason, by month of the reissue."""
    reissue = cheques.select(F.col("recid").alias("tranid"), F.col("cheqnum").alias("newnum"), "trandate")
    who = active_payees(payees).select("pid", "pname", "add1")
    reasons = codes.where("type = 'VoidType'").select(F.col("code").alias("voidtype"), F.col("desc").alias("reason"))
    rows = voids.join(reissue, "tranid", "left") if month is None else voids.join(in_month(reissue, month), "tranid")
    rows = (rows.where("trandate is not null").join(who, "pid", "left").join(reasons, "voidtype", "left")
            .join(reps.select("slpcode", "slpname"), "slpcode", "left"))
    keys = ["newnum", "cheqnum", "pid", "pname", "cheqdate", "iscrosscheq", "add1", "trandate", "reason", "remarks",
            "voidedby", "slpname"]
    return rows.groupBy(*keys).agg(total("payment").alias("payment")).select(
        F.coalesce("newnum", F.lit("0")).alias("newcheqnum"), F.col("cheqnum").alias("oldcheqnum"), "pid", "pname",
        "payment", "cheqdate", "iscrosscheq", "add1", "trandate", F.col("reason").alias("voidtype"), "remarks",
        "voidedby", "slpname")


def cheque_dashboard_counts(cheques: DataFrame, voids: DataFrame, payees: DataFrame, reps: DataFrame,
                            codes: DataFrame, month=None) -> DataFrame:
    """One row: processed, pending and voided cheques of the month."""
    rows = _with_payee(in_month(cheques, month), payees, reps)
    listed = rows.groupBy("cheqnum", "pid", "pname", "cheqdate", "iscrosscheq", "add1", "stat", "genid", "acctno").agg(
        F.count(F.lit(1)).alias("_n"))
    void = cheque_void_list(voids, cheques, payees, reps, codes, month).agg(F.count(F.lit(1)).alias("n"))
    stat = F.coalesce("stat", F.lit(PENDING))
    return listed.agg(F.count(F.when(stat == PROCESSED, 1)).alias("processed"),
                      F.count(F.when(stat == PENDING, 1)).alias("pending")).withColumn("void", void.scalar())


def cheque_transmittal(cheques: DataFrame, payees: DataFrame, reps: DataFrame, rep_code=None,
                       month=None) -> DataFrame:
    """Numbered cheques of the month with their payee and rep."""
    numbered = in_month(cheques, month).where(F.coalesce(F.col("cheqnum").try_cast("bigint"), F.lit(0)) > 0)
    rows = optional(_with_payee(numbered, payees, reps).where("r_rep is not null"), r_rep=rep_code)
    return rows.select("cheqnum", or_blank("pid").alias("pid"), or_blank("pname").alias("pname"),
                       or_zero("payment").alias("payment"), "cheqdate",
                       F.coalesce("iscrosscheq", F.lit(0)).alias("iscrosscheq"), or_blank("add1").alias("add1"),
                       "slpname", "recid")


def cheque_bank_reconcile(cheques: DataFrame, passbook: DataFrame, payees: DataFrame) -> DataFrame:
    """Processed cheques whose bank entry balances exactly."""
    issued = cheques.where(F.col("stat") == PROCESSED).groupBy(
        "pid", "cheqnum", "cheqdate", "iscrosscheq", "slpcode", "acctno", "genid").agg(total("payment").alias("payment"))
    entries = passbook.select("acctno", F.col("chknum").alias("cheqnum"), F.col("chkdate").alias("cleardate"), "credit",
                              "debit")
    bal = (F.col("payment") - F.col("credit") - F.col("debit")).cast("decimal(18,2)")
    matched = issued.withColumn("cheqnum", F.col("cheqnum").cast("string")).join(entries, ["acctno", "cheqnum"])
    return (matched.withColumn("bal", bal).where("bal = 0")
            .join(active_payees(payees).select("pid", "pname"), "pid", "left")
            .select("pid", "pname", "acctno", "cheqnum", "cheqdate", "cleardate", "payment", "genid", "bal"))


def cheque_lines(headers: DataFrame, lines: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Branch lines of cheques by (run, payee), branches in numeric order."""
    heads = headers.where("cheqnum is not null")
    if keys is not None:
        heads = heads.join(keys, keys.columns, "left_semi")
    parts = lines.select("pid", "genid", "linetotal", "whscode")
    return heads.select("pid", "genid", "cheqnum", "acctno").join(parts, ["pid", "genid"], "left").orderBy(
        "pid", "genid", "cheqnum", F.col("whscode").try_cast("int"), "whscode")


def journal_export(journal: DataFrame, lines: DataFrame, bank: DataFrame, as_of) -> DataFrame:
    """Cleared, unposted cheques not older than six months, with the bank's ledger code."""
    oldest = F.date_add(F.add_months(day(as_of), -6), 1)
    open_ = journal.where(F.col("transid").isNull() & F.col("cleardate").isNotNull()
                          & (F.col("cleardate") != day(UNCLEARED)) & (F.col("chkdate") >= oldest))
    return (open_.join(lines, "docentry").join(bank, "acctno", "left")
            .select("docentry", "transid", "benefname", "chknum", "chkdate", "whscode", "amt", "cleardate", "acctno",
                    F.concat("bankcode", F.lit(BANK_SUFFIX)).alias("bankcode")).orderBy("chknum"))


def chequebook_available(book: DataFrame, numbers: DataFrame, account=None, pattern=None,
                         search: bool = False) -> DataFrame:
    """Free cheque numbers: of the rebate books of an account, or (``search``) those containing a pattern.

    A search without a pattern finds nothing.
    """
    books = book.where((F.col("acctype") == BOOK_TYPE) & (F.col("whscode") == BOOK_BRANCH))
    free = numbers.where("stat = 0")
    if search:
        free = free.where(F.col("chknum").contains(F.lit(pattern).cast("string")))
    else:
        books = optional(books.where(F.col("chktype") == BOOK_USE), acctno=account)
    return books.select("id", "minchk", "maxchk", "acctno").join(free, "id").select(
        "id", "minchk", "maxchk", "chknum", "opnum", "stat", "acctno", "remarks")


class ChequeChange(NamedTuple):
    cheques: DataFrame
    numbers: DataFrame
    voids: DataFrame | None = None


def _numbers_with(book: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's (account, number) as keys of the number table."""
    return batch.join(book.select("id", "acctno"), "acctno").select("id", *[c for c in batch.columns if c != "acctno"])


def cheque_assign_number(cheques: DataFrame, book: DataFrame, numbers: DataFrame, batch: DataFrame) -> ChequeChange:
    """Give cheques (pid, genid) their number, account and date, and use up the numbers.

    ``batch``: pid, genid, cheqnum, cheqdate, iscrosscheq, slpcode, acctno.
    """
    assigned = keyed_update(cheques, batch, ["pid", "genid"], {
        c: c for c in ("cheqnum", "cheqdate", "iscrosscheq", "slpcode", "acctno")})
    used = _numbers_with(book, batch.select("acctno", F.col("cheqnum").alias("chknum")).distinct())
    return ChequeChange(assigned, keyed_update(numbers, used, ["id", "chknum"], {"stat": F.lit(1)}))


def cheque_void(cheques: DataFrame, book: DataFrame, numbers: DataFrame, batch: DataFrame, as_of) -> ChequeChange:
    """Void cheques by (genid, cheqnum, acctno): audit rows, reset headers, freed or remarked numbers.

    ``batch``: genid, cheqnum, acctno, voidtype, remarks, voidedby.
    """
    keys = ["genid", "cheqnum", "acctno"]
    audit = cheques.join(batch, keys).select(
        F.col("recid").alias("tranid"), "pid", "payment", "cheqnum", "cheqdate", "iscrosscheq",
        day(as_of).alias("recdate"), "slpcode", "voidtype", "remarks", "voidedby", "acctno")
    hit = keyed_update(cheques.withColumn("_void", F.lit(0)), batch, keys, {"_void": F.lit(1)})
    nulled = {c: F.when(F.col("_void") == 1, F.lit(None)).otherwise(F.col(c)).alias(c)
              for c in ("cheqnum", "cheqdate", "acctno")}
    nulled["stat"] = F.when(F.col("_void") == 1, PENDING).otherwise(F.col("stat")).alias("stat")
    reset = hit.select(*[nulled.get(c, F.col(c)) for c in cheques.columns])
    touched = _numbers_with(book, batch.where(F.col("voidtype").isin(CANCELLED, STALED)).select(
        "acctno", F.col("cheqnum").alias("chknum"), "voidtype", "remarks"))
    freed = keyed_update(numbers, touched, ["id", "chknum"], {
        "stat": F.when(F.col("new_voidtype") == CANCELLED, 0).otherwise(F.col("stat")), "remarks": "remarks"})
    return ChequeChange(reset, freed, audit)


def mark_processed_cheques(cheques: DataFrame, batch: DataFrame) -> DataFrame:
    """Cheques of (genid, cheqnum, acctno) become processed."""
    return keyed_update(cheques, batch, ["genid", "cheqnum", "acctno"], {"stat": F.lit(PROCESSED)})
