"""Statistics, certified cutoffs and the learned score."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitloom.llm import languages, quality_model, quality_rules

from .conftest import ODD, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_statistics_as_by_counting(documents):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  \t\n\n#*|é \x1c!A") for _ in range(rng.randrange(0, 90))) for _ in range(300)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(300)] + [r[1] for r in ODD] + ["a b c " * 5000]
    for r in quality_rules.statistics(documents(list(enumerate(texts))).select("doc_id", "text")).collect():
        assert (r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) == (r.doc_id, brute(texts[r.doc_id]))


@pytest.mark.parametrize("n", [0, 1, 50, 299, 5000, 200_000])
@pytest.mark.parametrize("alpha,delta", [(0.01, 0.05 / 15), (0.05, 0.01), (0.2, 1e-6)])
def test_binomial_bound_is_exact(spark, n, alpha, delta):
    k = spark.range(1).select(quality_rules.most_failures_allowed(F.lit(n), alpha, delta)).first()[0]
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log1p(-alpha)
            for i in range(min(n, int(n * alpha) + 5) + 1)]
    sums = np.cumsum(np.exp(logs))
    want = max([i for i, s in enumerate(sums) if s <= delta], default=-1)
    assert k == want


def labelled(documents, spark, good=1500, bad=300, wrong=0):
    """Good prose, junk full of symbols, and ``wrong`` good texts that look like junk."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"word{rng.randrange(5000)}" for _ in range(80))) for i in range(good)]
    rows += [(good + i, " ".join(f"word{rng.randrange(5000)}###" for _ in range(80))) for i in range(bad + wrong)]
    marks = [(i, 1) for i in range(good)] + [(good + i, int(i >= bad)) for i in range(bad + wrong)]
    return documents(rows), spark.createDataFrame(marks, "doc_id long, quality int"), good, bad


def test_rules_reject_junk_and_keep_good(documents, spark):
    docs, labels, good, bad = labelled(documents, spark)
    out = {r.doc_id: r for r in quality_rules.judged(docs, labels).collect()}
    assert all(out[i].kept for i in range(good)) and not any(out[i].kept for i in range(good, good + bad))
    assert set(out[good].broken) == {"symbols"} and quality_rules.good_documents(docs, labels).count() == good
    assert quality_rules.good_documents(docs, labels).columns == docs.columns


def test_no_cutoff_without_its_promise(documents, spark):
    docs, labels, _, _ = labelled(documents, spark, wrong=40)  # 2.6 % of the good would go
    assert quality_rules.judged(docs, labels).where("size(broken) > 0").count() == 0
    docs, labels, _, _ = labelled(documents, spark, good=300)  # too few to be sure of 1 %
    assert quality_rules.judged(docs, labels).where("size(broken) > 0").count() == 0


def test_odd_rows_of_rules(odd, labels):
    rows = quality_rules.judged(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 4, 6, 7))
    assert quality_rules.judged(odd.limit(0), labels).count() == 0
    assert quality_rules.judged(odd, labels.limit(0)).where("kept").select("doc_id").distinct().count() == 1  # the long one
    assert quality_rules.good_documents(odd, labels).count() == 2


def test_score_on_documents_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality_model.scored(docs, labels.select("doc_id", F.col("quality").alias("y")), lambda d: ~languages.held_out(d))
    held = scores.join(labels, "doc_id").where(languages.held_out(F.col("doc_id"))).collect()
    assert len(held) > 40 and np.mean([(r.score >= 0.3) == (r.quality == 1) for r in held]) > 0.9
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    again = quality_model.scored(docs.repartition(5), labels.select("doc_id", F.col("quality").alias("y")), lambda d: ~languages.held_out(d))
    both = scores.join(again.withColumnRenamed("score", "again"), "doc_id").select(F.max(F.abs(F.col("score") - F.col("again")))).first()[0]
    assert both < 1e-6


def test_isotonic_fit_rises_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (rng.uniform(size=500) < 1 / (1 + np.exp(-x))).astype(float)
    places, values = quality_model.rising_fit(x, y)
    assert (np.diff(values) > 0).all() and (np.diff(places) > 0).all() and 0 <= values[0] and values[-1] <= 1


def test_odd_rows_of_scores(odd, labels):
    known = labels.select("doc_id", F.col("quality").alias("y"))
    rows = quality_model.scored(odd, known, lambda d: F.lit(True)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_model.scored(odd, known.limit(0), lambda d: F.lit(True)).collect()} == {0.5}
    assert {r.score for r in quality_model.scored(odd, known.where("y = 1"), lambda d: F.lit(True)).collect()} == {1.0}
    assert quality_model.scored(odd.limit(0), known, lambda d: F.lit(True)).count() == 0
