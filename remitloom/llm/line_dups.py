"""Removing lines that repeat across documents.

Each line becomes a 128-bit hash of its key, with its document and position.
The hashes are range-partitioned together with their document, so one line
that a third of all documents share spreads over many partitions, and sorted
within by document and position: a stream over a partition meets the first
occurrence of a key in a document first and the rest behind it.  Those first
occurrences, one per key and document, are counted with partial sums.  What
comes back is no text but, per document, a sparse bitmap of the lines that go:
one 64-bit word for every 64 lines in which at least one goes.

``policy='all'`` drops every line of a key found in at least ``min_docs``
documents; ``policy='later'`` keeps its first occurrence, by document id and
position.

Defined cases: a null or empty text is one empty line; a null ``doc_id`` is an
id of its own, before all others; rows with the same id count as one document,
and if their texts differ each text has its own bitmap; a key shorter than
``min_chars`` never goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import freeze

STRIP = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends; A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def text_id(text: Column) -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_id, pos) of every line whose key is long enough.

    The text is hashed and split before its lines become rows, and goes no further.
    """
    key = F.col("_key")
    split = docs.select("doc_id", text_id(F.col("text")).alias("text_id"), lines_of(F.col("text")).alias("_lines"))
    return split.select("doc_id", "text_id", F.posexplode("_lines").alias("pos", "_line")).select(
        "doc_id", "text_id", "pos", line_key(F.col("_line")).alias("_key")).where(F.length(key) >= min_chars).select(
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), "doc_id", "text_id", "pos")


def first_occurrences(lines: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, first): each key's first place in each document, read off the sorted ranges."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = lines.repartitionByRange(n, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    return sorted_.groupBy("h1", "h2", "doc_id").agg(F.min(F.struct("pos", "text_id")).alias("first"))


def dropped_bitmaps(docs: DataFrame, min_docs: int, min_chars: int = 1, policy: str = "all") -> DataFrame:
    """(doc_id, text_id, dropped): for each document that loses lines, map of word number to 64 bits."""
    if policy not in ("all", "later"):
        raise ValueError(policy)
    lines = freeze(hashed_lines(docs, min_chars), "lines")
    frequent = first_occurrences(lines).groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("_docs"), F.min(F.struct("doc_id", "first")).alias("_first")).where(F.col("_docs") >= min_docs)
    # written, so that its true size decides the join, and a key with very many lines can be split over tasks
    keys = freeze(frequent.select(F.col("h1").alias("_k1"), F.col("h2").alias("_k2"), "_first"), "frequent")
    hit = lines.join(keys, (F.col("h1") == F.col("_k1")) & (F.col("h2") == F.col("_k2")))
    if policy == "later":
        hit = hit.where(~(F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & F.struct("pos", "text_id").eqNullSafe(F.col("_first.first"))))
    words = hit.groupBy("doc_id", "text_id", F.expr("pos div 64").cast("int").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("_bits"))
    return words.groupBy("doc_id", "text_id").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("dropped"))


def dense(bitmap: Column) -> Column:
    """A sparse bitmap as an array by word number, so that a line's bit is found at once."""
    entries = F.array_sort(F.map_entries(bitmap))
    before = F.concat(F.array(F.lit(-1)), F.transform(entries, lambda e: e["key"]))
    words = F.zip_with(entries, F.slice(before, F.lit(1), F.size(bitmap)), lambda e, last: F.concat(
        F.array_repeat(F.lit(0).cast("long"), e["key"] - last - 1), F.array(e["value"])))
    return F.flatten(words)


def split_documents(docs: DataFrame, min_docs: int, min_chars: int = 1, policy: str = "all") -> DataFrame:
    """(row, lines, kept) for every row of ``docs``: the row itself, its lines before dropping, and those that stay."""
    bitmaps = dropped_bitmaps(docs, min_docs, min_chars, policy).select(
        F.col("doc_id").alias("b_doc"), F.col("text_id").alias("b_text"), dense(F.col("dropped")).alias("dropped"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("own_text", text_id(F.col("row.text")))
    joined = rows.join(bitmaps, F.col("row.doc_id").eqNullSafe(F.col("b_doc")) & (F.col("own_text") == F.col("b_text")), "left")
    lines = lines_of(F.col("row.text"))
    goes = lambda i: F.coalesce(F.getbit(F.get("dropped", F.floor(i / 64).cast("int")), i % 64), F.lit(0)) == 1
    kept = F.when(F.col("dropped").isNull(), lines).otherwise(F.filter(lines, lambda line, i: ~goes(i)))
    return joined.select("row", lines.alias("lines"), kept.alias("kept"))


def without_repeated_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, policy: str = "all") -> DataFrame:
    """The documents with only the lines that stay; ``n_chars`` follows the text, where there is one."""
    text = F.when(F.col("row.text").isNotNull(), F.array_join("kept", "\n"))
    out = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return split_documents(docs, min_docs, min_chars, policy).select(*[out.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
