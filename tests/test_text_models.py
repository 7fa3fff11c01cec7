"""Hashed-word model and rule-based sentiment against plain versions."""

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import text as T
from panelforge.operators import rule_sentiment as R
from panelforge.operators import text_model as M

SF = "/root/testdata/sf0.1"


def plain_buckets(text):
    words = {w.strip(".,!?") for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans(M.UPPER, M.LOWER)))} - {""}
    return {int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in words}


def plain_probabilities(train, texts):
    held = [(plain_buckets(t), c) for t, c in train if c in M.CLASSES]
    n = {c: sum(k == c for _, k in held) for c in M.CLASSES}
    m, out = len(held), []
    counts = {c: {} for c in M.CLASSES}
    for buckets, c in held:
        for b in buckets:
            counts[c][b] = counts[c].get(b, 0) + 1
    for t in texts:
        if not (t or "").strip():
            out.append((0.0, 0.0, 1.0))
            continue
        logits = []
        for c in M.CLASSES:
            x = math.log((n[c] + 0.5) / (m + 1.5))
            for b in plain_buckets(t):
                p, q = counts[c].get(b, 0), sum(counts[k].get(b, 0) for k in M.CLASSES if k != c)
                if p + q:
                    d = math.log((p + 0.5) / (n[c] - p + 0.5)) - math.log((q + 0.5) / (m - n[c] - q + 0.5))
                    z2 = d * d / (1 / (p + 0.5) + 1 / (q + 0.5))
                    x += d * z2 * z2 / (z2 * z2 + 900)
            logits.append(x)
        e = [math.exp(x - max(logits)) for x in logits]
        out.append(tuple(x / sum(e) for x in e))
    return out


def scored(spark, model, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", T.scorer_udf(model.loader(df), batch=3)("text").alias("s")).orderBy("i").collect()
    return [tuple(r.s) for r in rows]


def test_text_model_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["gut", "schlecht", "ok", "naïve", "x y", "Ünder", "GOOD!", "bad,", "...", "so-so"]
    train = [(" ".join(rng.choice(vocabulary, rng.integers(0, 9))), str(rng.choice([*M.CLASSES, "other"]))) for _ in range(200)]
    train += [("good good\tgut", "positive")] * 40 + [("bad bad\nschlecht", "negative")] * 40 + [(None, "neutral"), ("", "positive"), ("bad", None)]
    texts = ["GOOD gut", "bad. schlecht!", "", "  \t", None, "unseen words", "x y naïve", "good " * 30_000, "good bad", "good bad"]
    model = M.fit_text_model(spark.createDataFrame(train, "text string, label string"))
    got, want = scored(spark, model, texts), plain_probabilities(train, texts)
    assert np.allclose(got, want, atol=1e-12)
    assert got[0][0] > 0.8 and got[1][1] > 0.8 and got[0] == pytest.approx(got[7], abs=0.2) and got[8] == got[9]


def test_text_model_without_rows(spark):
    model = M.fit_text_model(spark.createDataFrame([], "text string, label string"))
    assert scored(spark, model, ["a b", ""]) == [pytest.approx((1 / 3, 1 / 3, 1 / 3)), (0, 0, 1)]


def test_labelled_texts_takes_a_bounded_sample(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = spark.range(60).select(F.when(F.col("id") < 58, F.col("id")).alias("doc_id"), F.lit("neutral").alias("label"))
    assert M.labelled_texts(docs, labels, "doc_id").count() == 50
    few = [r.doc_id for r in M.labelled_texts(docs, labels, "doc_id", 20).collect()]
    assert 0 < len(few) <= 20 and few and sorted(few) == sorted(r.doc_id for r in M.labelled_texts(docs, labels.repartition(7), "doc_id", 20).collect())


def auc(x, y):
    ranks = pd.Series(x).rank().to_numpy()
    n1 = y.sum()
    return (ranks[y].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_text_model_held_out(spark):
    """One in five labelled documents held out: each class against the others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    docs = docs.select("doc_id", "text", label.alias("label"))
    model = M.fit_text_model(docs.where("doc_id % 5 <> 0"))
    rows = docs.where("doc_id % 5 = 0").select("label", T.scorer_udf(model.loader(docs))("text").alias("s")).select("label", "s.*").toPandas()
    got = {c: auc(rows[f"prob_{c}"].to_numpy(), (rows["label"] == c).to_numpy()) for c in M.CLASSES}
    print(got)
    assert got["positive"] > 0.88 and got["negative"] > 0.8 and got["neutral"] > 0.88


def plain_sentiment(text, lexicon):
    text = text or ""
    ws = [w for w in re.split(r"[^A-Za-z']+", text) if w]
    low = [w.lower() for w in ws]
    n_loud = sum(w == w.upper() and w != w.lower() for w in ws)
    mixed, but = 0 < n_loud < len(ws), low.index("but") if "but" in low else None
    found = [(i, k) for i in range(len(ws)) for k in (1, 2, 3) if i + k <= len(ws) and lexicon.get(" ".join(low[i : i + k]), 0)]
    total = 0.0
    for i, k in found:
        if any(j < i + k and i < j + n and (n > k or (n == k and j < i)) for j, n in found):
            continue
        weight = lexicon[" ".join(low[i : i + k])]
        x, written = abs(weight), " ".join(ws[i : i + k])
        for d, near in ((1, 1.0), (2, 0.95), (3, 0.9)):
            before = low[i - d] if i >= d else ""
            x += 0.293 * near * ((before in T.STRONGER) - (before in T.WEAKER))
        x += 0.733 * (mixed and written == written.upper())
        x *= -0.74 if any(i >= d and low[i - d] in T.NEGATIONS for d in (1, 2, 3)) else 1
        x *= 1 if but is None or i == but else 0.5 if i < but else 1.5
        total += math.copysign(1, weight) * x
    questions = text.count("?")
    loud = min(text.count("!"), 4) * 0.292 + (0.96 if questions >= 4 else questions * 0.18 if questions >= 2 else 0)
    total += (total > 0) * loud - (total < 0) * loud
    return total / math.sqrt(total * total + 15)


def test_rule_sentiment_equals_plain_version(spark):
    lexicon = {"good": 1.9, "bad": -2.5, "not bad": 1.1, "bad idea": -1.5, "not bad at": 0.7, "kill": -3.0, "to kill for": 2.0, "zero": 0.0, "but": 0.3, "it's": 0.1}
    rng = np.random.default_rng(8)
    words = ["good", "GOOD", "bad", "Bad", "BAD", "not", "idea", "at", "very", "slightly", "but", "to", "kill", "for", "zero", "it's", "x", "never", "SO", "!", "??", "?"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 25))) for _ in range(300)] + ["", None, " ?!", "GOOD BAD BAD", "good", "but", "not bad at bad idea", "a thing to KILL FOR", "good but " * 9_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(5)
    terms = spark.createDataFrame(list(lexicon.items()), "term string, weight double")
    got = {r.id: r.compound for r in R.rule_sentiment(df, "id", "body", terms).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_sentiment(t, lexicon), abs=1e-9), t


def test_rule_sentiment_empty(spark):
    nothing = spark.createDataFrame([], "term string, weight double")
    df = spark.createDataFrame([(1, "good")], "id int, body string")
    assert [tuple(r) for r in R.rule_sentiment(df, "id", "body", nothing).collect()] == [(1, 0.0)]
    assert R.rule_sentiment(df.limit(0), "id", "body", nothing).count() == 0

def test_rule_sentiment_shuffles_no_words(spark, monkeypatch):
    """A lexicon larger than those that are broadcast gives the same scores; the broadcast way has no shuffle of words at all."""
    words = ["good", "GOOD", "bad", "not", "idea", "very", "but", "it's", "x", "!", "??", "é"]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(3)
    lexicon = {"good": 1.5, "bad": -2.0, "bad idea": -1.0, "not bad idea": 0.5, "Good": 9.0, "a b c d": 9.0}
    terms = spark.createDataFrame(list(lexicon.items()), "term string, weight double")
    told = R.rule_sentiment(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text", terms)
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    told = {r.id: r.compound for r in R.rule_sentiment(df, "id", "body", terms).collect()}
    monkeypatch.setattr(R, "MOST_TERMS", 0)
    monkeypatch.setattr(R, "GROUP_BYTES", 500)
    met = {r.id: r.compound for r in R.rule_sentiment(df, "id", "body", terms).collect()}
    assert len(met) == len(texts)
    for i, t in enumerate(texts):
        want = plain_sentiment(t, {k: w for k, w in lexicon.items() if k == k.lower()})
        assert told[i] == pytest.approx(want, abs=1e-9) and met[i] == pytest.approx(want, abs=1e-9), t


def test_term_counts(spark):
    df = spark.createDataFrame([("The cat, the CAT", 1), ("cat the", None), ("dog", None), (None, 1)], "t string, m int")
    counts = {r.hash: (r.n, r.marks) for r in R.term_counts(df.repartition(3), "t", "m").collect()}
    names = ["the", "cat", "the cat", "cat the", "the cat the", "cat the cat", "dog"]
    hashes = [R.hashed_terms(spark.createDataFrame([(w, 1.0)], "term string, weight double")).first().hash for w in names]
    assert [counts.pop(h) for h in hashes] == [(2, 1), (2, 1), (1, 1), (2, 1), (1, 1), (1, 1), (1, None)] and not counts
