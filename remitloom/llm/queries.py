"""The registered queries of this subpackage and, where SQL can express one, its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    languages, line_dups, mixing, near_dups, neighbours, periodic, personal_data, pieces, quality_model, quality_rules, repeated_spans, secret_scan,
    token_alignment)

MIX_SQL = """
with sized as (
  select doc_id, source, md5('mix' || coalesce(cast(doc_id as varchar), '')) as key,
         cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size
  from documents),
src as (
  select source, sum(size)::bigint as ssize,
         [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as w
  from sized group by source),
ranked as (
  select *, row_number() over (order by ssize / w, source is null, source) as n from src),
tries as (  -- k sources stop at their limit
  select k.n - 1 as k,
         3 * (select sum(ssize) from src) * 50 - 200 * coalesce((select sum(ssize) from ranked r where r.n < k.n), 0) as left_pct,
         (select sum(w) from ranked r where r.n >= k.n) as weights, k.ssize, k.w
  from ranked k),
cut as (select k, left_pct, weights from tries where left_pct * w <= 200 * ssize * weights order by k limit 1),
target as (
  select source, ssize, case when n > (select k from cut) then (select left_pct from cut)::double * w / (100.0::double * (select weights from cut))
         else 2.0::double * ssize end as target
  from ranked),
ordered as (
  select doc_id, source, size, coalesce(sum(size) over (partition by source order by key, doc_id, size
           rows between unbounded preceding and 1 preceding), 0) as before
  from sized),
planned as (
  select o.*, t.ssize, t.target, case when t.ssize > 0 then floor(t.target / t.ssize) else 0 end::bigint as epochs
  from ordered o join target t on o.source is not distinct from t.source)
select doc_id, size, ssize as source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * ssize - before)))::bigint as taken
from planned
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of each document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


LINES_SQL = """
with split as (
  select doc_id, n, unnest(lines) as line, generate_subscripts(lines, 1) as pos
  from (select doc_id, row_number() over () as n, string_split(coalesce(text, ''), chr(10)) as lines from documents)),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from split),
frequent as (select key from keyed where length(key) >= 1 group by key having count(distinct coalesce(doc_id::varchar, 'null')) >= 10)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256
from keyed k left join frequent f on k.key = f.key
group by n
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents have."""
    split = line_dups.split_documents(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10)
    return split.select("row.doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
                        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of the certified rules."""
    return quality_rules.judged(documents(spark, sf_dir), labels(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")


NEAR_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') as w from documents),
listed as (
  select doc_id, list_distinct(case when len(w) >= 3 then [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]
                                    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
items as (select doc_id, len(s) as n, unnest(s) as item from listed),
links as (
  select a.doc_id as x, b.doc_id as y from items a join items b on a.item = b.item and a.doc_id < b.doc_id
   and 85 * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (
  select x, y from (select x, y from links union all select y, x from links)
  union
  select r.x, e.y from reach r join (select x, y from links union all select y, x from links) e on r.y = e.x)
select l.doc_id, len(l.s)::bigint as n_shingles, least(l.doc_id, coalesce(m.least, l.doc_id)) as component_id,
       l.doc_id = least(l.doc_id, coalesce(m.least, l.doc_id)) as kept
from listed l left join (select x, min(y) as least from reach group by x) m on l.doc_id = m.x
"""

SPANS_SQL = """
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (
  select doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
gone as (
  select distinct v.doc_id, unnest(range(v.i, v.i + 50)) as i
  from (select doc_id, i, min(doc_id) over (partition by h) as first from windows) v where v.doc_id > v.first),
kept as (
  select s.doc_id, s.i, s.word, g.i is not null as out
  from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from words) s left join gone g on s.doc_id = g.doc_id and s.i = g.i)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(k.n, 0)::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from words d left join (
  select doc_id, count(*) filter (where out) as n, string_agg(word, ' ' order by i) filter (where not out) as t from kept group by doc_id) k
  on d.doc_id = k.doc_id
"""


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share most of their three-word shingles."""
    return near_dups.near_duplicates(documents(spark, sf_dir), shingle=3, num=85, den=100)


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that a document with a smaller id has."""
    return repeated_spans.without_repeats(documents(spark, sf_dir), 50).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Where the vocabulary of the registered queries lies; operators take any path.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    encoded = pieces.encode(documents(spark, sf_dir), pieces.Vocabulary.load(VOCABULARY))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "exact")


def op4_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is of good quality, as labels of other documents teach it."""
    known = labels(spark, sf_dir).select("doc_id", F.col("quality").alias("y"))
    scores = quality_model.scored(documents(spark, sf_dir), known, lambda doc_id: ~languages.held_out(doc_id))
    return scores.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every twentieth vector."""
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = personal_data.find(documents(spark, sf_dir))
    names = F.array(*[F.lit(k) for k in personal_data.KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(personal_data.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(joined("spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"),
                        F.size("all_spans").cast("long").alias("n_spans"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents of the other folds."""
    docs = documents(spark, sf_dir)
    found = languages.identify(docs, docs.where(~languages.held_out(F.col("doc_id"))))
    return found.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials of known forms in every document, and strings too new for their place."""
    found = secret_scan.find(documents(spark, sf_dir))
    names = F.array(*[F.lit(k) for k in secret_scan.KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])],
                        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, words joined by one space; in a tenth of the documents a passage repeats from some word to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = docs.select("doc_id", F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), 1).alias("w"), h.alias("h"), g.alias("g"))
    planted = (F.col("h") % 10 == 0) & (F.size("w") > 0)
    n = F.greatest(F.size("w"), F.lit(1))
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    passage = F.slice("w", a + 1, p)
    rest = F.slice(F.flatten(F.array_repeat(passage, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return words.select("doc_id", F.array_join(F.when(planted, F.concat(F.slice("w", F.lit(1), a), rest)).otherwise(F.col("w")), " ").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of every document that repeat a passage at least four times, and the text without the repetitions."""
    found = periodic.find(with_planted_runs(documents(spark, sf_dir))).withColumn("_longest", periodic.longest_run())
    written = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    length, period = -F.col("_longest.l"), F.col("_longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_longest.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.concat(F.array_join(written, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias(
            "runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: Runs by brute force: every pair of equal words of a document at every lag up to a quarter of it, islands of them, none inside an island of a smaller lag.
RUNS_SQL = """
with words as (
  select doc_id, row_number() over () as d, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
         cast(list_reduce(flatten([[4294967295::bigint]] || [[ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::varchar, '')]),
           lambda c, x: case when x >= 0 then xor(c, x) else xor(c // 2, (c % 2) * 3988292384) end) as bigint) as c
  from documents),
sized as (select *, len(w) as n, xor(c, 4294967295) as h from words),
parts as (select *, case when n > 0 then (h // 10) % n else 0 end as a, (h // 10) % 8 + 3 as parts from sized),
period as (select *, 1 + (n - a) // parts as p from parts),
words2 as (
  select doc_id, d, n, i, w[(case when h % 10 = 0 and i >= a then a + (i - a) % p else i end) + 1] as word
  from (select *, unnest(range(0, n)) as i from period)),
same as (
  select x.d, x.i, y.i - x.i as q from words2 x join words2 y on x.d = y.d and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (
  select d, q, min(i) as start, count(*) + q as length from (select d, q, i, i - row_number() over (partition by d, q order by i) as island from same)
  group by d, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (
  select * from islands r where not exists (
    select 1 from islands s where s.d = r.d and s.q < r.q and s.start <= r.start and s.start + s.length >= r.start + r.length)),
gone as (select distinct d, unnest(range(start + q, start + length)) as i from runs),
kept as (
  select v.d, string_agg(v.word, ' ' order by v.i) as t from words2 v where not exists (select 1 from gone g where g.d = v.d and g.i = v.i) group by v.d),
listed as (
  select d, count(*)::bigint as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as t,
         arg_min({'s': start, 'l': length, 'q': q}, (-length, start, q)) as best
  from runs group by d)
select z.doc_id, coalesce(l.n_runs, 0) as n_runs, best.s::bigint as start, best.l::bigint as length, best.q::bigint as period,
       (1000 * best.l // best.q)::bigint as exponent_milli, sha256(coalesce(l.t, '')) as runs_sha256, sha256(coalesce(k.t, '')) as collapsed_sha256
from words z left join listed l on l.d = z.d left join kept k on k.d = z.d
"""

#: Where the byte-level vocabulary of the registered query lies; the operator takes any path.
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens two tokenizers cut every document into, and how common their pairs are."""
    return token_alignment.align(documents(spark, sf_dir), token_alignment.Tokenizers.load(BYTE_VOCABULARY, VOCABULARY))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_near_duplicates, op3_neighbours, op4_quality_score, op5_personal_data, op6_line_dedup, op7_repeated_spans, op8_quality_rules, op9_language,
    op10_mix_sources, op11_secrets, op12_periodic_runs, op13_token_alignment)}
SQL = {"op2_near_duplicates": NEAR_SQL, "op6_line_dedup": LINES_SQL, "op7_repeated_spans": SPANS_SQL, "op10_mix_sources": MIX_SQL, "op12_periodic_runs": RUNS_SQL}
