"""Edge cases of the corpus operators: odd rows, empty tables, hot groups, long texts, brute-force versions."""

import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from panelforge.llm import common, compression_quality, jaccard, mixing, neighbours, oracles, pieces, ppm, quality_rules, queries, toxicity, url_filter

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in rel.fetchall()), key=repr)
    assert want and rows_of(df) == want


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(5000)] + [(2, "x"), (3, None), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    got = rows_of(common.labelled_sample(docs, labels, "quality", 10, modulus=1_000_003))
    assert got == [(1, "text 0", 1), (2, "x", 0), (3, "", 0)]


def test_shared_folder_must_be_set_on_a_cluster(spark):
    class Far:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Far)


def test_ppm_slices_cut_long_texts_without_loss(monkeypatch):
    rng = random.Random(1)
    texts = [ppm.spelled([bytes(rng.choices(b"abcd", k=rng.randrange(1, 9))) for _ in range(n)]) for n in (0, 3, 400, 1, 90, 0, 7)]
    monkeypatch.setattr(ppm, "SLICE", 100)
    got = Counter()
    for first, rows, packed in ppm.slices(texts):
        for p in packed.tolist():
            assert (p & 0xFFFF) < rows
            got[first + (p & 0xFFFF), p >> 16] += 1
    want = Counter()
    for row, text in enumerate(texts):
        for i in range(ppm.ORDER, len(text)):
            key = text[i]
            for k in range(1, ppm.ORDER + 1):
                key |= text[i - k] << (8 * (ppm.ORDER - k + 1))
            want[row, key] += 1
    assert got == want


def test_neighbours_prune_clustered_data(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((100, 32))
    x = np.repeat(centres, 10, 0) + 0.15 * rng.standard_normal((1000, 32))
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got: dict = {}
    for r in neighbours.search(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 1000, 50):
        sims = u @ u[q]
        sims[q] = -9
        hits += len(got[q] & {*np.lexsort((np.arange(1000), -sims))[:5].tolist()})
    assert hits / 100 >= 0.9
    near = np.sort(u @ u.T, axis=1)[:, -6]
    distance = math.sqrt(2 - 2 * np.quantile(near, 0.1))
    hashes = neighbours._fewest_visits(u, distance)
    visited = np.zeros((20, 1000), bool)
    for table, (who, code) in enumerate(neighbours.probes(u[::50], hashes, distance, neighbours.TARGET)):
        a, b = neighbours._planes(32, table, hashes)
        codes = neighbours._code(np.floor((u @ a + b) / neighbours.WIDTH).astype(np.int64))
        for q in range(20):
            visited[q] |= np.isin(codes, code[who == q])
    assert visited.mean() < 0.3


def test_neighbours_edges(spark):
    kind = "vec_id long, embedding array<double>, bucket int, key int"
    assert neighbours.search(spark.createDataFrame([], kind)).count() == 0
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [3.0, 0.0]), (4, [0.5, 0.0]), (1, [4.0, 0.0]), (9, [9.0, 0.0]), (7, [1.0, 1e-9])]
    got = neighbours.search(spark.createDataFrame([(*r, 1, 1) for r in rows], kind)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 7] or [r.vec_id for r in got] == [1, 2, 3, 4, 9]
    alone = neighbours.search(spark.createDataFrame([(0, [1.0], 1, 1), (50, [1.0, 2.0], 1, 1)], kind))
    assert alone.count() == 0  # lengths differ


NAIVE_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def naive_hits(lexicon, raw):
    """Every entry at every place, by hand."""
    plain = raw.lower()
    mended = ""
    for part in re.split(r"([\w@$!]+)", plain):
        core = part.rstrip("!")
        if sum(c.isalpha() for c in core) >= 2 and any(c in NAIVE_DIGITS for c in core):
            core = "".join(NAIVE_DIGITS.get(c, c) for c in core)
        mended += core + part[len(part.rstrip("!")) :]
    hits, excused = {}, set()
    for text in (plain, mended):
        for at in range(len(text)):
            if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
                continue
            for phrase in lexicon.exceptions:
                end = at + len(phrase)
                if text.startswith(phrase, at) and not (end < len(text) and (text[end].isalnum() or text[end] == "_")):
                    excused.update(range(at, end))
            for entry, weight in lexicon.entries.items():
                end = at + len(entry.rstrip("*"))
                if text.startswith(entry.rstrip("*"), at) and (entry.endswith("*") or not (end < len(text) and (text[end].isalnum() or text[end] == "_"))):
                    hits[at] = max(hits.get(at, 0.0), weight)
    return {a: w for a, w in hits.items() if a not in excused}


def test_toxicity_equals_naive_matching():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "shit": 3.0, "scum": 2.0, "tras*": 1.0, "trash": 5.0, "ass hole": 2.5})
    auto, rng = lexicon.automaton(), random.Random(6)
    parts = ["idiot", "1diot", "idi0t!", "5hit", "$hit", "sh1t", "pond scum", "scum", "trash can", "trash", "trasher", "tr4sh bin", "1st", "3d", "xidiot", "idiots", "_scum", "ass hole", "@ss h0le", "77", "a", "ok!!", "\n"]
    for _ in range(400):
        text = " ".join(rng.choices(parts, k=rng.randrange(0, 12)))
        assert lexicon.hits(text, auto) == naive_hits(lexicon, text), text
    for word in ("1diot", "5hit", "$hit", "idi0t!"):
        assert lexicon.hits(word, auto), word
    assert not lexicon.hits("1st 3d 77", auto)


def test_toxicity_time_is_linear(spark):
    lexicon = toxicity.Lexicon({"scum": 2.0})
    auto = lexicon.automaton()
    for text in ("a" * 1_000_000, "a0" * 500_000, "0" * 1_000_000, "pond scum " * 100_000):
        began = time.perf_counter()
        lexicon.hits(text, auto)
        assert time.perf_counter() - began < 5
    empty = spark.createDataFrame([], "doc_id long, text string, score int")
    assert toxicity.score_documents(empty, lexicon).count() == 0 and toxicity.filter_documents(empty, lexicon).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(empty, labels).entries


def test_toxicity_filter_keeps_columns_and_new_lexicons_count(spark):
    docs = spark.createDataFrame([(1, "you scum", 5), (2, None, 6), (2, None, 6), (3, "fine", 7)], "doc_id long, text string, c0 int")
    strict = toxicity.Lexicon({"scum": 9.0}, weights=(-1.0, 9.0, 0.0))
    mild = toxicity.Lexicon({"fine": 9.0}, weights=(-1.0, 9.0, 0.0))
    assert rows_of(toxicity.filter_documents(docs, strict)) == [(2, None, 6), (2, None, 6), (3, "fine", 7)]
    assert rows_of(toxicity.filter_documents(docs, mild)) == [(1, "you scum", 5), (2, None, 6), (2, None, 6)]


def test_compression_scores_equal_sizes_by_hand(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choices(["plain", "words", "of", "good", "text", "here"], k=60)) for _ in range(40)]
    bad = [" ".join(rng.choices(["xx", "zz$", "##", "qq", "%%", "kk&"], k=60)) for _ in range(40)]
    rows = [(i, t, int(i < 40)) for i, t in enumerate(good + bad)] + [(900, "long good text of plain words " * 20_000, 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = compression_quality.fit(docs, labels, per_class=1000)
    got = {r.doc_id: r.score for r in compression_quality.score_documents(docs, model).collect()}
    for i, text, _ in rows:
        raw = text.encode()
        size = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw)) for d in (model.good, model.bad)]
        diff, shrunk = (size[1] - size[0]) / max(size), math.log((max(size) + 1) / (len(raw) + 20))
        z = np.dot(model.weights, [1, diff, shrunk, diff**2, shrunk**2, diff * shrunk])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-np.clip(z, -30, 30))), abs=0.02)  # a prepared dictionary may differ by a byte
    assert min(got[i] for i in range(40)) > 0.5 > max(got[i] for i in range(40, 80)) and got[900] > 0.5
    assert b"".join(compression_quality._segments(bytes(range(256)) * 99)) == bytes(range(256)) * 99 and compression_quality._segments(b"") == []
    # the end of a long text trains as well as its start
    few = compression_quality.fit(docs, labels, per_class=1000, segments=5)
    assert few.good and few.bad and few.weights != model.weights
    assert compression_quality.score_documents(docs.limit(0), model).count() == 0
    assert compression_quality.fit(docs.limit(0), labels.limit(0)).weights == (0.0,) * 6


def test_pieces_keep_user_columns(spark):
    with open(pieces.MODEL, "rb") as f:
        model = pieces.Pieces(f.read())
    long = "some longer text, with words. " * 60
    rows = [(1, long, 42, 7), (1, long, 42, 7), (2, long, 43, 8), (3, None, 1, 1), (4, "", 1, 1), (5, "wordwithoutanyspace" * 100, 2, 2), (6, "short", 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_job int, piece_copies int")
    got = pieces.encode_documents(docs, chunk_chars=64, giant_chars=128, check=True)
    assert got.columns == [*docs.columns, "piece_ids", "n_chunks", "decoded_equal"]
    seen = Counter()
    for r in got.collect():
        assert list(r.piece_ids) == model.lib.encode(r.text or "") and r.decoded_equal
        seen[r.doc_id, r.text, r.piece_job, r.piece_copies] += 1
    assert seen == Counter(rows)
    assert pieces.encode_documents(docs.limit(0)).count() == 0


def test_quality_rules_edges(spark):
    docs = spark.createDataFrame([(1, "12345 67890 " * 20, 1), (2, "good plain words stand here in a row of more than twenty words so that no rule has any reason to say no to it", 2)], "doc_id long, text string, t int")
    assert [r.doc_id for r in quality_rules.filter_documents(docs).collect()] == [2]
    assert {r.doc_id: r.kept for r in quality_rules.measure_documents(docs).collect()} == {1: False, 2: True}
    empty = docs.limit(0)
    assert quality_rules.measure_documents(empty).count() == 0 and quality_rules.cascade_order(empty) == list(quality_rules.RULES)
    assert sorted(quality_rules.cascade_order(docs)) == sorted(quality_rules.RULES)


def test_mixing_rates_in_the_thousands_and_salts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", 1.0), (2, None, 1.0), (3, "b", 1.0)], "doc_id long, source string, mix_cdf double")
    got = mixing.mix_sources(docs, weights={"a": 1.0}, total=5000.0)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {1} and abs(got.count() - 5000) < 400
    plain = rows_of(mixing.mix_sources(docs, total=30.0).select("doc_id", "mix_copy"))
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", 0)
    assert rows_of(mixing.mix_sources(docs, total=30.0).select("doc_id", "mix_copy")) == plain


def test_url_ties_long_and_empty(spark):
    rules = spark.createDataFrame([("block", "a.org", "/x"), ("allow", "a.org", "/x"), ("allow", "org", "/x/yy")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.a.org/x/yyy"), (3, "http://a.org/" + "p" * 200_000)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: ("a.org/x", "block"), 2: ("org/x/yy", "allow"), 3: (None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_cascade_orders_by_conditional_rejection_and_cost(spark):
    """The costly rule goes last though it rejects as much; a rule that repeats an earlier one drops behind one that adds to it."""
    docs = spark.range(600).select((F.col("id") % 10).alias("k"), F.concat(F.lit("a b c "), F.repeat(F.lit("word "), 200)).alias("t"))
    costly = F.size(F.array_sort(F.transform(F.split("t", ""), lambda x: F.md5(x.cast("binary"))))) > F.when(F.col("k") < 5, 0).otherwise(10**6)
    rules = {"costly": costly, "same": F.col("k") < 4, "half": F.col("k") < 5, "other": F.col("k") == 9}
    steps = {s.name: s for s in quality_rules.plan_cascade(docs, rules)}
    names = list(steps)
    assert names[-1] == "costly" and names.index("half") < names.index("same") and names.index("other") < names.index("same")
    assert steps["half"].evaluated == 1 and steps["half"].rejects == pytest.approx(0.5, abs=0.08)
    assert steps["other"].evaluated == pytest.approx(0.5, abs=0.08) and steps["same"].rejects == 0 and steps["costly"].evaluated == pytest.approx(0.4, abs=0.08)
    assert steps["costly"].cost == 16 * steps["half"].cost


def test_keep_one_with_any_column_names(spark):
    """Columns named like the join's own, and copies of a row, do no harm."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 5, 6, 7), (2, text, 5, 6, 7), (1, text, 5, 6, 7), (3, "quite another text of a few words in a row", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, jaccard_id int, jaccard_0 int, c0 int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and rows_of(kept) == [rows[0], rows[3]]


def test_copies_of_a_set_are_one_before_their_signatures(spark):
    """100,000 copies of one text and two near copies: the exploded side holds three sets."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega"
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(base).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(100_000, base + " more"), (100_001, base + " again")], "doc_id long, text string"))
    join = jaccard._Join(docs, "doc_id", "text", 4, 85)
    assert join.distinct_sets().count() == 3
    got = jaccard.link_documents(docs).groupBy("component_id").count().collect()
    assert [tuple(r) for r in got] == [(0, 100_002)]


@pytest.mark.parametrize("most", [3, 600])
def test_lengths_without_a_limit(spark, monkeypatch, most):
    """1,200 vector lengths at once, one of them frequent, one query short of its target: all found exactly as by brute force."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbours, "MOST_PROBES", most)
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(400)]
    data += [(1000 + i, [1.0] * (9 + i // 2) + [float(i % 2)]) for i in range(2400)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = np.array([v for i, v in data[:400]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    right = 0
    for q in range(0, 400, 50):
        sims = unit @ unit[q]
        sims[q] = -2
        right += len(set(got[q]) & set(np.argsort(-sims)[:5].tolist()))
    assert right >= 36
    by_length = {}
    for i, v in data[400:]:
        by_length.setdefault(len(v), []).append(i)
    for q in range(1000, 3400, 50):
        assert got[q] == [i for i in by_length[len(dict(data)[q])] if i != q]


def test_keep_one_keeps_other_texts_of_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    kind = "doc_id long, text string, first int"
    c = b.replace("b", "c")
    docs = spark.createDataFrame([(7, a, 1), (7, b, 2), (3, a, 3), (9, c, 1), (9, b.replace("b", "d"), 2), (9, c, 4), (None, a, 5), (8, None, 6), (8, None, 6)], kind)
    got = sorted((r.doc_id or 0, (r.text or "-")[0]) for r in jaccard.keep_one(docs).collect())
    assert got == [(0, "a"), (3, "a"), (7, "b"), (8, "-"), (8, "-"), (9, "c"), (9, "d")]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_jaccard_tells_sets_apart(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(40)] + [(100 + i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(0, 40, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in jaccard._Join(docs, "doc_id", "text", 4, 85, bits=3).run().collect()}
    assert got == {i: i % 100 for i, _ in rows}


def test_jaccard_many_shingles_in_a_group(spark):
    # sets so large that hash groups hold over 255 shingles, and pairs on both sides of the mark
    def words(n, salt):
        rng = random.Random(salt)
        return [f"{rng.random():.9f}" for _ in range(n)]

    n = 255 * jaccard.GROUPS // 2 + 40_000
    base = words(n, 1)
    near = base[: n * 95 // 100] + words(n * 5 // 100, 2)
    far = base[: n * 80 // 100] + words(n * 20 // 100, 3)
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.link_documents(docs).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_count_tree_finds_all_pairs_across():
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 5, (20, jaccard.GROUPS))
    points = np.clip(np.repeat(centres, 15, 0) + rng.integers(-1, 2, (300, jaccard.GROUPS)) * (rng.uniform(size=(300, jaccard.GROUPS)) < 0.03), 0, 254).astype(np.uint8)
    sizes, parts = points.sum(1).astype(np.int64), np.arange(300) % 7
    tree = jaccard.CountTree(points, sizes, parts)
    for i in range(300):
        bound = np.minimum(points, points[i]).sum(1).astype(np.int64)
        want = set(np.flatnonzero((bound * 185 >= 85 * (sizes + sizes[i])) & (parts != parts[i])))
        assert set(tree.search(points[i], int(sizes[i]), int(parts[i])).tolist()) == want


def test_common_groups_of_blank_texts_are_none():
    assert len(jaccard.Pigeonholes().every(jaccard.shingle_set(None, jaccard._Hashes()))) == 0


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_linked_sets_share_one_of_few_signatures(percent):
    """Sets that just link share a signature, whatever is common; a set has hardly more of them than shingles it may differ in."""
    rng = np.random.default_rng(3)
    linked = 0
    for _ in range(3000):
        n = int(rng.choice([1, 2, 4, 5, 6, 7, 9, 13, 20, 60, 400]))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 3).astype(np.uint64))
        shared, mine, others = n - int(rng.integers(0, n // 8 + 2)), int(rng.integers(0, n // 8 + 2)), int(rng.integers(0, n // 8 + 2))
        order = rng.permutation(len(pool))[: shared + mine + others]
        x, y = np.sort(pool[order[: shared + mine]]), np.sort(pool[np.concatenate((order[:shared], order[shared + mine :]))])
        holes = jaccard.Pigeonholes(percent, rng.permutation(pool.view(np.int64))[: int(rng.integers(0, len(pool)))])
        a, b = holes.signatures(x), holes.signatures(y)
        assert len(a) <= len(x) * (100 - percent) / 100 + 2
        if 0 < shared < shared + mine + others and 100 * shared >= percent * (shared + mine + others):
            linked += 1
            assert len(np.intersect1d(a, b))
    assert percent == 100 or linked > 300


def test_blocks_are_cut_between_sizes_that_cannot_link():
    sizes = jaccard.Sizes(85)
    name = lambda n, k: sizes.prefix(n) | k
    rows = [(7, name(100, 1)), (7, name(100, 1)), (7, name(110, 0)), (7, name(128, 5)), (7, name(400, 2)), (8, name(10, 3)), (8, name(12, 4)), (9, name(9, 1)), (9, name(10, 3))]
    for cut in (1, 2, 3, 5, 9):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + cut]], pa.int64()) for i in (0, 1)], ["sig", "kind"]) for at in range(0, len(rows), cut)]
        got = [r for out in jaccard._blocks(sizes)(batches) for r in zip(*(out.column(i).to_pylist() for i in range(3)), strict=True)]
        assert sorted(r[1:] for r in got) == sorted([(name(n, k), name(100, 1)) for n, k in ((100, 1), (110, 0), (128, 5))] + [(name(n, k), name(9, 1)) for n, k in ((9, 1), (10, 3))])
        assert len({r[0] for r in got}) == 2
    for n in [*range(1, 200), 1000, 33_333]:
        assert not sizes.apart(np.int64(sizes.prefix(n)), np.int64(sizes.prefix(n * 100 // 85)))
        assert (sizes.prefix(n * 100 // 85) - sizes.prefix(n)) >> sizes.NAME_BITS <= sizes.reach


def test_counting_common_shingles_leaves_no_shuffle_behind(spark):
    """These files lay on the disk until the end of the join."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a passage that every one of these texts begins with "), F.col("id").cast("string")).alias("text"))
    join = jaccard._Join(docs, "doc_id", "text", 4, 85)
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    assert len(join.common())
    assert not files() - before
