"""The pipeline against a plain version that works out every row."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
from panelforge.llm import jaccard, pieces, quality_rules, toxicity
from panelforge.llm.common import table

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars int"


def plain_passes(text):
    """The quality rules on one text."""
    text = text or ""
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    chars, letters = sum(map(len, words)), sum(c.isalpha() for c in text)
    return not (len(words) < 20 or 100 * len(repeated) > 30 * len(words) or 10 * sum(c in "#*$%&|<>" for c in text) > 3 * len(words)
                or chars > 25 * len(words) or chars < 2 * len(words) or 10 * (len(lines) - len(set(lines))) > 3 * len(text.split("\n")) or 10 * letters < 6 * chars)


def plain_keepers(rows):
    """Of linked texts (five words, 0.8) the row with the smallest id; ids are unique here."""
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i for i in ids if top(i) == i}


def plain_copies(rows):
    """Poisson counts by the distribution function, source by source."""
    n = Counter(r.source for r in rows)
    whole, out = sum(math.sqrt(c) for c in n.values()), Counter()
    for r in rows:
        rate = len(rows) * math.sqrt(n[r.source]) / (whole * n[r.source])
        unit, k, p, below = int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52), 0, math.exp(-rate), 0.0
        while below + p <= unit:
            below, k = below + p, k + 1
            p *= rate / k
        if k:
            out[r.doc_id] = k
    return out


def test_pipeline_rows_exactly(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = table(spark, SF, "documents")
    ruled = [r for r in docs.collect() if plain_passes(r.text)]
    # the lexicon is learnt; its matching has a test of its own
    lexicon = toxicity.fit(spark.createDataFrame(ruled, docs.schema), table(spark, SF, "labels"))
    auto = lexicon.automaton()
    clean = [r for r in ruled if lexicon.score(lexicon.features([r.text], auto))[0] < 0.5]
    keep = plain_keepers(clean)
    alone = {r.doc_id: r for r in clean if r.doc_id in keep}
    assert 50 < len(alone) < len(clean)
    assert Counter(r.doc_id for r in got) == plain_copies(list(alone.values()))
    with open(pieces.MODEL, "rb") as f:
        model = pieces.Pieces(f.read())
    for r in {r.doc_id: r for r in got}.values():
        want = alone[r.doc_id]
        assert (r.text, r.lang, r.source, r.n_chars) == (want.text, want.lang, want.source, want.n_chars) and list(r.piece_ids) == model.lib.encode(r.text)


def test_quality_rules_equal_plain_version(spark):
    docs = table(spark, SF, "documents")
    assert {r.doc_id for r in quality_rules.filter_documents(docs).collect()} == {r.doc_id for r in docs.collect() if plain_passes(r.text)}


def test_stages_take_odd_rows(spark):
    good = "plain words stand here in a row of more than twenty words so that no rule has any reason to say no to this"
    rows = [(None, good, "en", "s", 1), (1, None, None, None, None), (2, "", "en", None, 0), (3, good, "en", "s", 1), (3, good, "en", "s", 1), (3, good.upper() + " indeed it is another one", "en", "t", 2), (4, good + " " + " ".join(f"w{i}" for i in range(30_000)), "en", "s", 9)]
    for docs in (spark.createDataFrame(rows, KIND), spark.createDataFrame([], KIND)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, SF)
            assert out.columns == corpus_pipeline.COLUMNS, name
            docs = spark.createDataFrame(out.collect(), KIND)
        last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
        assert last.columns == [*corpus_pipeline.COLUMNS, "piece_ids", "n_chunks"] and last.count() == docs.count()


def test_jaccard_stage_links_at_four_fifths(spark):
    text = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 200), ("a", 242), ("b", 200), ("b", 252))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(text)], KIND)
    # five-word Jaccard 196 / 238 = 0.824 and 196 / 248 = 0.790
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard_stage(spark, docs, SF).collect()) == [0, 2, 3]
    assert jaccard.SHINGLE == 4  # the operator's own default is that of its query
