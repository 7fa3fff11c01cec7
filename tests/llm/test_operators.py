"""Corpus operators against brute force, and their edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import compression_quality, jaccard, mixing, neighbours, pieces, ppm, quality_rules, token_files, toxicity, url_filter

SF = "/root/testdata/sf0.001"
ODD = [(None, "no id at all here", "x"), (1, None, "x"), (2, "", None), (3, " \t\n ", "x"), (4, "ab cd", "x"), (4, "ab cd", "x"), (5, "wörd " * 3000, "y"), (8, "a b c d e f g h i", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, a long text, and extra columns with clashing names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(7).alias(c) for c in ("score", "chunk", "id", "win", "kind", "sig", "n", "label", "t", "w", "path", "part", "held_out", "n_words", "rate", "cdf", "mix_key", "piece_ids", "value")])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_ppm_equals_trie(spark, docs):
    got = {r.doc_id: r for r in ppm.score_documents(docs, chunk_chars=100_000).collect()}
    trie, counts, rows = ppm.ByteTrie(), Counter(), docs.collect()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            words = ppm.words_of(r.text.encode())
            counts.update([*words, b"\n"])
            for step in ppm.ByteTrie.steps(words):
                trie.add(*step)
    total, kinds = sum(counts.values()), len(counts)
    known: dict = {}
    for r in rows:
        words, g = ppm.words_of(r.text.encode()), got[r.doc_id]
        score = 0.0
        for step in ppm.ByteTrie.steps(words):
            if step not in known:
                known[step] = trie.log10(*step)
            score += known[step]
        assert g.score == pytest.approx(score, rel=1e-9)
        assert g.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in [*words, b"\n"]), rel=1e-9)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(words) + 1, sum(counts[w] > 0 for w in [*words, b"\n"]), total)


def test_ppm_sums_to_one():
    trie = ppm.ByteTrie()
    for context, symbol in ppm.ByteTrie.steps([b"abra", b"cadabra", b"abba"]):
        trie.add(context, symbol)
    letters = [s for s in range(256) if s not in (9, 11, 12, 13)]
    for words in ([b"ab"], [b"zz", b"q"], []):
        context = list(ppm.ByteTrie.steps(words))[-1][0]
        assert sum(10 ** trie.log10(context, s) for s in letters) == pytest.approx(1)


def test_ppm_edges(spark, odd):
    got = ppm.score_documents(odd).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert ppm.score_documents(odd.limit(0)).count() == 0
    assert ppm.adaptive_scores(odd.where("length(text) < 100")).where("bits > 0").count() >= 5


def test_neighbours_recall_and_edges(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in neighbours.search(rows).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    all_rows = rows.collect()
    ids, x = np.array([r.vec_id for r in all_rows]), np.array([r.embedding for r in all_rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        sims = x @ x[i]
        sims[i] = -9
        best = np.lexsort((ids, -sims))[:5]
        found = got[ids[i]]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(abs(sims[list(ids).index(v)] - s) < 1e-12 for v, s in found.values())
        hits += len({*ids[best]} & {v for v, _ in found.values()})
    assert hits / (5 * len(got)) >= 0.9
    few = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (50, [-1.0, 0.1]), (7, [float("nan"), 1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (100, [1.0])]
    r = neighbours.search(spark.createDataFrame(few, "vec_id long, embedding array<float>").withColumn("table", F.lit(1))).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.vec_id) for x in r] == [(0, 1), (0, 9), (0, 50), (50, 0), (50, 1), (50, 9)]


def test_large_bucket_of_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(9000)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 4500").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_neighbours_count_ids_not_rows(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    once = sorted(map(tuple, neighbours.search(rows).collect()))
    assert sorted(map(tuple, neighbours.search(rows.union(rows)).collect())) == once
    near = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 + 0.0001 * i]) for i in range(6)] + [(1, [2.0, 0.002])] * 6 + [(i, [1.0, 0.01 * i]) for i in range(2, 9)]
    got = neighbours.search(spark.createDataFrame(near, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and got[0].score == pytest.approx(1 / math.sqrt(1 + 1e-6), abs=1e-12)


def test_toxicity(spark, odd):
    lex = toxicity.Lexicon({"idiot": 4.0, "lowei*": 4.0, "trash": 4.0}, weights=(-3.0, 2.0, 1.0))
    texts = ["you IDI0T, really", "уou іdiоt", "loweichen are here", "put it in the trash can now", "idiotic plans", "", None]
    f = lex.features(texts, lex.automaton())
    assert [bool(x) for x in f[:, 0]] == [True, True, True, False, False, False, False]
    out = toxicity.score_documents(odd, lex).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.97
    assert toxicity.fit(docs, labels.limit(0)).entries


def test_compression_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = compression_quality.fit(docs, labels)
    scored = compression_quality.score_documents(docs, model).join(labels, "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    assert compression_quality.score_documents(odd, model).count() == len(ODD)
    assert compression_quality.score_documents(odd, compression_quality.fit(docs, labels.limit(0))).where("score <> 0.5").count() == 0


def test_mixing(spark, odd):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"))
    got = {r.source: r["count"] for r in mixing.mix_sources(rows, weights={"big": 1.0, "s1": 1.0, "s2": 2.0}).groupBy("source").count().collect()}
    assert set(got) == {"big", "s1", "s2"} and abs(got["s2"] - 10_000) < 400 and abs(got["big"] - 5000) < 300
    a, b = (sorted(map(tuple, mixing.mix_sources(odd).select("doc_id", "mix_copy", "mix_key").collect()), key=str) for _ in range(2))
    assert a == b
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_token_scan(spark, tmp_path, odd):
    rng = random.Random(2)
    lengths = [rng.choice([0, 1, 2, 9, 40, 700]) for _ in range(200)]
    # the end id is 0xC450: 0x5005 before 0x00C4 has its bytes across two tokens; 10 and 0x0A0A hold the byte that ranges are cut at
    flat = [t for n in lengths for t in [*rng.choices([5, 10, 0x0A0A, 0x5005, 0x00C4, 0x50C4, 0xC4], k=n), token_files.END_ID]] + [5, 0x5005]
    cuts = [0, 17, 18, 400, 400, len(flat)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / f"part-{i:05d}-x").write_bytes(np.array(flat[a:b], "<u2").tobytes())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in ("2003", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = token_files.scan_token_files(spark, str(tmp_path)).orderBy("path", "ordinal").collect()
        assert [r.n_tokens for r in got] == [*lengths, 2] and [r.closed for r in got] == [True] * 200 + [False]
        assert [r.ordinal for r in got if r.path.endswith("00004-x")] == list(range(sum(r.path.endswith("00004-x") for r in got)))
    for k, v in before.items():
        spark.conf.set(k, v)
    assert token_files.count_documents(odd.limit(0)).count() == 0
    mixed = odd.select("doc_id", "text").repartition(3, "text")  # not a plain scan
    assert token_files.count_documents(mixed).count() == len(ODD)
    encode = token_files._encoder(token_files.read_ranks(token_files.VOCABULARY)).encode_ordinary
    got = Counter((r.doc_id, r.n_tokens) for r in token_files.count_documents(odd).collect())
    assert got == Counter((i, len(encode(t or ""))) for i, t, _ in ODD)


def test_pieces(spark, odd):
    with open(pieces.MODEL, "rb") as f:
        model = pieces.Pieces(f.read())
    rng = random.Random(3)
    texts = ["", " ", "a  b\n", "x" * 90, "漢字 éü ▁▁ x ▁", " " * 40 + "b", "".join(rng.choice("abceetinos éü漢 \n▁0") for _ in range(900)), "".join(rng.choice("abetins") for _ in range(400))]
    for t in texts:
        want = model.lib.encode(t)
        assert np.frombuffer(model.encode(t), np.int32).tolist() == want
        for chunk in (7, 50, 333):
            assert pieces.scan_encode(model, t, chunk) == want
    got = pieces.encode_documents(odd, chunk_chars=512, giant_chars=1024).collect()
    assert Counter((r.doc_id, tuple(r.piece_ids)) for r in got) == Counter((i, tuple(model.lib.encode(t or ""))) for i, t, _ in ODD)
    assert max(r.n_chunks for r in got) > 10 and pieces.decode(model, got[-1].piece_ids) == (got[-1].text or "")


def test_quality_rules(spark, odd):
    got = quality_rules.measure_documents(odd).collect()
    assert len(got) == len(ODD) and all(r.base_failed for r in got if r.doc_id in (1, 2, 3, 4))
    assert next(r for r in got if r.doc_id == 5).n_repeat_words == 3000
    assert quality_rules.filter_documents(odd.limit(0)).count() == 0
    assert quality_rules.filter_documents(odd).columns == odd.columns


def test_url_edges(spark):
    urls = [(1, None), (2, "no scheme"), (3, "HTTP://A.Net/x?y"), (4, "http://en.example.net/en/a"), (5, "x://example.com"), (6, "http://anet/"), (7, "http://net"), (8, "http://example.com/de/#"), (8, "http://example.com/de/#")]
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit(1))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect() if r.page_id > 2)
    assert got[0] == (3, "a.net", "/x", "net/", "block") and got[1][3] == "example.net/en/" and got[2][2:] == ("", None, "allow")
    assert got[3][3] is None and got[4] == (7, "net", "", None, "allow") and got[5] == got[6] and got[5][4] == "block"
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(60)], []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 20, 40, 90, 150]))]
        for _ in range(rng.choice([1, 3, 8, 20])):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                x[rng.randrange(len(x))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(x)))
    rows += [(5000, None), (5003, ""), (5006, " \n ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_edges(spark, odd):
    got = jaccard.link_documents(odd).collect()
    assert len(got) == len(ODD)
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert jaccard.link_documents(odd.limit(0)).count() == 0
