"""Mixing sources to target weights.

Every document gets a key from a hash, which puts the documents of a source in
a random order that reruns repeat.  The leading digits of the key cut a source
into ranges; sizes are summed per range, the ranges' sums are added up in key
order, and within a range the documents are.  A source then gives its documents
in key order until its budget of words is spent, once more from the start for
each epoch that the budget needs.  No task holds more of a source than one of
its ranges, so a source with most of the rows is spread over all of them.

Defined cases: a null text or one without words has size 0 and is taken 0
words; a null source is a source of its own, last in order; a null ``doc_id``
takes the place of an empty one; repeated rows count as often as they stand in
the table; rows that are equal in id and size are interchangeable.  ``mix`` keeps
rows of one id in one range, so ids should be near to unique there;
``mixed_documents`` tells them apart by text and counts equal rows first.
Sources are ranked in one task, at a few numbers a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import freeze

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the key that name a range: 4,096 ranges a source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words: starts of runs that are not white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sort_key(doc_id: Column, seed: str) -> Column:
    """A random but repeatable place in the order of a source."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sources: DataFrame, weights: list[int], share_pct: int, most: int) -> DataFrame:
    """Words each source shall give; from (source, source_size), one row a source.

    Sources take the weights in turn, in code point order, null last.  A target
    that would pass ``most`` times the source's size stops there, and the rest
    share what is left by weight.  With sources in order of size to weight, the
    ones that stop are a leading run, and the first place where the next one
    stays below its limit ends it.  The table has one row a source.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    placed = sources.withColumn("_place", F.row_number().over(by_name) - 1).withColumn("_weight", weight.cast("long"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("_weight"), "_place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    shared = placed.select(
        "*", (F.sum("source_size").over(whole) * share_pct).alias("_total_pct"),
        F.sum("_weight").over(whole).alias("_weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_stopped"),
        F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_stopped_weight"))
    # left to share, times 100, if all before this source stop; it stays below its own limit if left / weights * weight <= limit
    left = F.col("_total_pct") - 100 * most * F.col("_stopped")
    weights_left = F.col("_weights") - F.col("_stopped_weight")
    fits = left * F.col("_weight") <= 100 * most * F.col("source_size") * weights_left
    marked = shared.withColumn("_first", F.when(fits, F.struct(left.alias("left"), weights_left.alias("weights"))))
    first = F.first("_first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    open_ = F.max(fits).over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(open_, F.col("_share.left") * F.col("_weight") / (F.lit(100.0) * F.col("_share.weights"))).otherwise(
        (most * F.col("source_size")).cast("double"))
    return marked.select("*", first.alias("_share"), open_.alias("_open")).select(
        "source", "source_size", F.when(F.col("_open"), target).otherwise(
            (most * F.col("source_size")).cast("double")).alias("target"))


def measured(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, key) of every document, without its text."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), sort_key(F.col("doc_id"), seed).alias("key"))


def prefix_sums(sized: DataFrame, ties=("doc_id", "size")) -> DataFrame:
    """Adds ``before``: the words of the same source that stand before a row in order of key, then ``ties``."""
    ranged = sized.withColumn("_range", F.substring("key", 1, RANGE_DIGITS))
    sums = ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"),
                          F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("source", "_range").orderBy("key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return running.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).withColumn(
        "before", F.col("_before") + F.col("_offset")).drop("_s", "_r", "_range", "_before", "_offset")


def mix(docs: DataFrame, weights=(5, 2, 1), share_pct: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """What a mix takes of each document, by words: exactly each source's budget.

    Returns doc_id, source, size, key, before, source_size, target and taken.
    The document on which a budget ends gives only its words up to there.
    """
    sized = freeze(measured(docs, seed), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share_pct, most)
    targets = freeze(targets, "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.select(F.col("source").alias("_source"), "source_size", "target", epochs.cast("long").alias("_epochs")).withColumn(
        "_rest", F.floor("target").cast("long") - F.col("_epochs") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("before")))
    return prefix_sums(sized).join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "taken", (F.col("_epochs") * F.col("size") + last).cast("long")).drop("_source", "_epochs", "_rest")


def text_key(doc_id: Column, text: Column, seed: str) -> Column:
    """As ``sort_key``, with the text: rows without id, or that share one, are told apart by what they hold."""
    return sort_key(F.concat_ws("\n", F.coalesce(doc_id.cast("string"), F.lit("")), F.xxhash64(text).cast("string")), seed)


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), share_pct: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: whole documents, a row for each time one is taken.

    A document is taken in the last, partial epoch if it begins before the
    source's budget ends.  Where that is becomes one key per source, so the
    texts are neither shuffled nor sorted.  Rows of equal id and text have one
    key and are counted before keys are sorted; if the budget ends among them,
    as many of them are taken as it still asks for, in order of all columns
    (which must be of types that Spark can group).  A source without words
    gives nothing.
    """
    keyed = docs.select("source", word_count(F.col("text")).alias("size"), text_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    sized = freeze(keyed.groupBy("source", "key").agg(
        F.sum("size").alias("size"), F.max("size").alias("one"), F.count(F.lit(1)).alias("rows")), "mix-sizes")
    targets = freeze(source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share_pct, most), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.select(F.col("source").alias("_source"), epochs.cast("long").alias("_epochs"), (
        F.floor("target").cast("long") - epochs.cast("long") * F.col("source_size")).alias("_rest"))
    begun = prefix_sums(sized, ties=[]).where("size > 0").join(plan, F.col("source").eqNullSafe(F.col("_source"))).where("before < _rest")
    wanted = F.least(F.col("rows"), F.ceil((F.col("_rest") - F.col("before")) / F.col("one"))).alias("wanted")
    cuts = begun.groupBy(F.col("_source").alias("_s")).agg(F.max(F.struct("key", wanted)).alias("cut"))
    cuts = freeze(plan.join(cuts, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
        F.col("_source").alias("mix_source"), F.col("_epochs").cast("int").alias("epochs"), F.col("cut.key").alias("last"),
        F.col("cut.wanted").alias("wanted")), "mix-cuts")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    key = text_key(F.col("row.doc_id"), F.col("row.text"), seed)
    of_source = F.col("row.source").eqNullSafe(F.col("mix_source"))
    in_last = F.coalesce((key < F.col("last")).cast("int"), F.lit(0))
    times = F.when(F.col("row.text").rlike(WORD), F.col("epochs") + in_last)
    taken = rows.join(cuts, of_source).withColumn("times", F.coalesce(times, F.lit(0)))
    at_cut = rows.join(cuts.where("last is not null"), of_source & (key == F.col("last"))).groupBy("row", "mix_source", "wanted").agg(
        F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("mix_source").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    ends = at_cut.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).withColumn(
        "times", F.greatest(F.lit(0), F.least(F.col("rows"), F.col("wanted") - F.col("before"))).cast("int"))
    return taken.select("row", "times").unionByName(ends.select("row", "times")).where("times > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
