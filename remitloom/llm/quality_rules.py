"""Quality rules whose cutoffs come with a bound on wrong rejections.

A rule compares one statistic of a text with a cutoff.  Labelled documents
choose the cutoffs: for each rule and each stratum (a range of text lengths),
cutoffs are tried from the most lenient on, and one is certified if the exact
binomial bound says that it rejects more than ``alpha`` of the good documents
only with a probability of ``delta`` over all rules and strata together.  That
probability is shared among rules and strata; within one of them the cutoffs
are tested in a fixed order and the first that fails ends the row, which needs
no further correction.  Of the certified cutoffs the one that best separates
the labelled good and bad documents that earlier rules leave is used, ties to
the more lenient one; if none is certified or none helps, the rule rejects
nothing in that stratum.

Everything is SQL functions over arrays of words.

Defined cases: a null or empty text has no words and fails the base rule; of
several labels of one document the highest counts; labels that are null or of
unknown documents are ignored; without labels only the base rule acts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import freeze

SPACES = r"[\x20\x09-\x0D]+"
#: Lower ends of the strata, in words.
STRATA = (0, 200, 1000)
#: From the most lenient to the strictest, for every rule; fixed before any label is seen.
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05)
#: Statistics that a rule may reject for being above a cutoff, from the columns of ``statistics``.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "shouting": "n_upper / greatest(word_chars, 1)",
    "exclaiming": "n_exclaims / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
}


def count_of(text: Column, others: str) -> Column:
    """Characters left when every one that matches ``others`` is taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of every whole text beside its columns.

    For ``n_repeat_words`` the hashes of the 3-word windows are sorted with their positions; neighbours with equal
    hashes are repeats.  A repeated window covers three words, less those that the next one covers.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    start = docs.select(
        *[docs[c] for c in docs.columns], count_of(text, SPACES).alias("word_chars"), count_of(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        count_of(text, r"[^A-Z]+").alias("n_upper"), count_of(text, r"[^!]+").alias("n_exclaims"),
        F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("_hashes"))
    n = F.size("_hashes")
    at = lambda i: F.get(F.col("_hashes"), i)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    with_windows = start.select("*", n.cast("long").alias("n_words"), windows.alias("_windows")).drop("_hashes")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    with_pairs = with_windows.select("*", pairs.alias("_pairs")).drop("_windows")
    near = lambda k: F.get(F.col("_pairs"), k)["h"]
    places = F.sort_array(F.transform(
        F.filter("_pairs", lambda x, k: F.coalesce(near(k - 1) == x["h"], F.lit(False)) | F.coalesce(near(k + 1) == x["h"], F.lit(False))),
        lambda x: x["i"]))
    with_places = with_pairs.select("*", places.alias("_places")).drop("_pairs")
    covered = F.aggregate(F.transform("_places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_places", k + 1) - p, F.lit(3)))),
                          F.lit(0), lambda total, x: total + x)
    return with_places.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("_places")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    return sum(((F.col("n_words") >= low).cast("int") for low in STRATA[1:]), F.lit(0))


def most_failures_allowed(n: Column, alpha: float, delta: float) -> Column:
    """Largest k for which seeing at most k of ``n`` has probability ``delta`` or less if each has ``alpha``; -1 if none.

    Sums binomial probabilities from 0 on, each from the one before, in logarithms.
    """
    odds = math.log(alpha) - math.log1p(-alpha)
    start = F.struct(F.lit(0.0).alias("total"), (n * math.log1p(-alpha)).cast("double").alias("log"), F.lit(-1).alias("k"))

    def step(acc, i):
        total = acc["total"] + F.exp(acc["log"])
        return F.struct(total.alias("total"), (acc["log"] + F.log((n - i) / (i + 1.0)) + odds).alias("log"),
                        F.when(total <= delta, i.cast("int")).otherwise(acc["k"]).alias("k"))

    # the mean number of failures bounds k from above for any delta below one half
    return F.aggregate(F.sequence(F.lit(0), F.ceil(n * alpha).cast("int")), start, step)["k"]


def certified_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float, delta: float) -> dict[str, dict[int, float]]:
    """For each rule, stratum -> cutoff, where one is certified and useful: one number for each rule and stratum at most.

    ``stats``: doc_id and the columns of ``statistics``; ``labels``: doc_id and quality.  Only documents that the base
    rule leaves are judged, as only they meet the rules.  Every test counts all of them; what a cutoff is worth counts
    only those that the rules before do not reject already.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    rows = freeze(stats.where(~base_failed()).join(marked, "doc_id").select(
        "good", stratum().alias("stratum"), *[F.expr(v).alias(k) for k, v in RULES.items()]), "rule-labels")
    tests, chosen, caught = len(RULES) * len(STRATA), {}, F.lit(False)
    for rule in RULES:
        tried = rows.select("good", "stratum", caught.alias("caught"), F.col(rule).alias("value"), F.explode(F.array(*[F.lit(c) for c in CUTOFFS])).alias("cutoff"))
        out, count = F.col("value") > F.col("cutoff"), lambda c: F.sum(c.cast("int")).cast("int")
        counted = tried.groupBy("stratum", "cutoff").agg(
            count(F.col("good")).alias("good"), count(~F.col("good")).alias("bad"), count(out & F.col("good")).alias("good_out"),
            count(out & F.col("good") & ~F.col("caught")).alias("good_new"), count(out & ~F.col("good") & ~F.col("caught")).alias("bad_new"))
        passed = counted.withColumn("passed", (F.col("good") > 0) & (F.col("good_out") <= most_failures_allowed(F.col("good"), alpha, delta / tests)))
        by_stratum = passed.groupBy("stratum").agg(F.max(F.when(~F.col("passed"), F.col("cutoff"))).alias("failed_at"), F.collect_list(F.struct(
            F.expr("bad_new / greatest(bad, 1) - good_new / greatest(good, 1)").alias("gain"), "cutoff", "passed")).alias("row"))
        useful = F.filter("row", lambda x: x["passed"] & (x["gain"] > 0) & (F.col("failed_at").isNull() | (x["cutoff"] > F.col("failed_at"))))
        chosen[rule] = {r["stratum"]: r["cutoff"] for r in by_stratum.select("stratum", F.array_max(useful)["cutoff"].alias("cutoff")).where(
            "cutoff is not null").collect()}
        caught = caught | breaks(F.col("stratum"), F.col(rule), chosen[rule])
    return chosen


def breaks(own: Column, value: Column, cutoffs: dict[int, float]) -> Column:
    """Whether a value is above the cutoff of its stratum."""
    limit = F.lit(None).cast("double")
    for k, cutoff in cutoffs.items():
        limit = F.when(own == k, F.lit(cutoff)).otherwise(limit)
    return F.coalesce(value > limit, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05, keep_text: bool = False) -> DataFrame:
    """Statistics, ``base_failed``, ``broken`` (names of rules) and ``kept`` for every row of ``docs``.

    ``alpha``: share of good documents that one rule may reject wrongly in a stratum; ``delta``: probability that any
    rule in any stratum breaks that promise.  The statistics are frozen, with the documents' own columns if ``keep_text``.
    """
    stats = freeze(statistics(docs if keep_text else docs.select("doc_id", "text")).drop(*[] if keep_text else ["text"]), "rule-statistics")
    cutoffs = certified_cutoffs(stats, labels, alpha, delta)
    broken = F.array_compact(F.array(*[F.when(breaks(stratum(), F.expr(v), cutoffs[k]), F.lit(k)) for k, v in RULES.items()]))
    return stats.select("*", base_failed().alias("base_failed"), broken.alias("broken")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken") == 0))


def good_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """The documents that pass the base rule and every certified cutoff."""
    wanted = docs.select(*[docs[c].alias(f"_d_{c}") for c in docs.columns if c not in ("doc_id", "text")], docs["doc_id"], docs["text"])
    kept = judged(wanted, labels, alpha, delta, keep_text=True).where("kept")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_d_{c}").alias(c) for c in docs.columns])
