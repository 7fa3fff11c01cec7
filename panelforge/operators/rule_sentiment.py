"""Rule-based sentiment with a lexicon table of any size, phrases included.

Words are cut and looked up in whole batches of texts, where they stand: a term is known
by a 64-bit hash of its lower-case words, so no word is shuffled to be scored. A lexicon
of up to MOST_TERMS terms is broadcast as two sorted arrays; a larger one is met in a
shuffle, by the distinct hashes of groups of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.text import BOOST, NEAR, NEGATED, NEGATIONS, QUESTION, SHOUT, STRONGER, WEAKER
from panelforge.storage import discard, stored

# What a word in capitals adds, and what counts before and after a "but".
CAPITALS, BEFORE_BUT, AFTER_BUT = 0.733, 0.5, 1.5
LONGEST = 3  # words of a term
#: Terms that are broadcast (16 bytes each); text of a group of the shuffled way, and of a step inside a task.
MOST_TERMS, GROUP_BYTES, STEP_BYTES = 8_000_000, 64 << 20, 1 << 20
#: Distinct hashes that a task counts before it hands them on.
_HELD = 4_000_000
_WORDS_KEPT = 500_000
_BLANKED = bytes(c if chr(c).isascii() and (chr(c).isalpha() or c == 39) else 32 for c in range(256))
_BOOSTS = {w.encode(): 1.0 for w in STRONGER} | {w.encode(): -1.0 for w in WEAKER}
_NEGATIONS = {w.encode() for w in NEGATIONS}
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K[0]
    x = (x ^ (x >> np.uint64(29))) * _K[1]
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Word as written -> its place in arrays of what the rules ask of it; place 0 is no word."""

    def __init__(self) -> None:
        self._new(1 << 16)

    def _new(self, room: int) -> None:
        self.hash, self.boost = np.zeros(room, np.uint64), np.zeros(room)
        self.negation, self.capitals, self.loud, self.but = (np.zeros(room, bool) for _ in range(4))

    def __missing__(self, word: bytes) -> int:
        i = len(self) + 1
        if i >= len(self.hash):
            for name in ("hash", "boost", "negation", "capitals", "loud", "but"):
                a = getattr(self, name)
                setattr(self, name, np.concatenate((a, np.zeros_like(a))))
        low, up = word.lower(), word.upper()
        self.hash[i], self.boost[i] = xxhash.xxh64_intdigest(low), _BOOSTS.get(low, 0.0)
        self.negation[i], self.capitals[i], self.loud[i], self.but[i] = low in _NEGATIONS, word == up, word == up != low, low == b"but"
        self[word] = i
        return i

    def placed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, text) of each place: texts in a row, LONGEST places without a word (text -1) around each."""
        if len(self) > _WORDS_KEPT:
            self.clear()
            self._new(1 << 16)
        split = [t.translate(_BLANKED).split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        of = np.repeat(np.arange(len(texts)), n)
        at = np.arange(len(of)) + LONGEST * (of + 1)
        words, text = np.zeros(len(of) + LONGEST * (len(texts) + 1), np.int64), np.full(len(of) + LONGEST * (len(texts) + 1), -1)
        words[at] = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, len(of))
        text[at] = of
        return words, text

    def terms(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hash, whether there is one) of the terms of 1 to LONGEST words that begin at each place."""
        h, there = np.zeros(len(words), np.uint64), np.ones(len(words), bool)
        for k in range(LONGEST):
            later = _shifted(words, k)
            there = there & (later > 0)
            h = _mix((h + _K[2]) * _K[1] ^ self.hash[later])
            yield h.view(np.int64), there


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x[i + by] at i; what crosses the ends is a place without a word."""
    return np.roll(x, -by)


def _steps(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of a batch's rows of about STEP_BYTES."""
    texts = [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]
    ends = np.cumsum([len(t) for t in texts]) // STEP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)] if texts else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield a, texts[a:b]


def _scores(texts: list[bytes], seen: _Words, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The texts' compounds by a lexicon of sorted hashes."""
    words, text = seen.placed(texts)
    size, weight = np.zeros(len(words), np.int64), np.zeros(len(words))
    for k, (h, there) in enumerate(seen.terms(words), 1):
        if len(keys):  # of several terms at one place the longest counts
            asked = np.flatnonzero(there)
            asked = asked[np.argsort(h[asked])]  # in order, so that the search stays in the cache
            at = np.minimum(np.searchsorted(keys, h[asked]), len(keys) - 1)
            hit = keys[at] == h[asked]
            size[asked[hit]], weight[asked[hit]] = k, weights[at[hit]]
    # a longer overlapping term beats it, and one as long that begins earlier
    beaten = size == 0
    for k in range(1, LONGEST):
        before, after = _shifted(size, -k), _shifted(size, k)
        beaten |= ((before > k) & (before >= size)) | ((size > k) & (after > size))
    capitals = seen.capitals[words]
    for k in range(1, LONGEST):
        capitals = capitals & ((size <= k) | seen.capitals[_shifted(words, k)])
    counted = np.flatnonzero(~beaten)
    of, w, size = text[counted], weight[counted], size[counted]
    n_loud, n_words = (np.bincount(text[x], minlength=len(texts)) for x in (seen.loud[words], text >= 0))
    near, turned = np.zeros(len(counted)), np.zeros(len(counted), bool)
    for k, x in enumerate(NEAR, 1):
        b = words[counted - k]
        near += BOOST * x * seen.boost[b]
        turned |= seen.negation[b]
    shout = np.where(((n_loud > 0) & (n_loud < n_words))[of] & capitals[counted], CAPITALS, 0.0)
    buts = np.flatnonzero(seen.but[words])
    but = np.full(len(texts), -1)
    but[text[buts[::-1]]] = buts[::-1]  # the first one is written last
    contrast = np.where(but[of] < 0, 1.0, np.where(counted < but[of], BEFORE_BUT, np.where(counted > but[of], AFTER_BUT, 1.0)))
    x = np.bincount(of, (w + np.sign(w) * (near + shout)) * np.where(turned, NEGATED, 1.0) * contrast, len(texts))
    calls, asks = (np.array([t.count(c) for t in texts]) for c in (b"!", b"?"))
    x = x + np.sign(x) * (np.minimum(calls, 4) * SHOUT + np.where(asks >= 4, 0.96, np.where(asks >= 2, asks * QUESTION, 0.0)))
    return x / np.sqrt(x * x + 15)


def _sorted_lexicon(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, weights = rows["hash"].to_numpy(), rows["weight"].to_numpy()
    keys, first = np.unique(keys, return_index=True)
    return keys, weights[first]


def term_counts(df: DataFrame, text_col: str, mark_col: str) -> DataFrame:
    """(hash, n, marks): for each term of one to LONGEST words, the rows that hold it and the sum of their marks (whole numbers; null if none has one).

    Tasks count before the shuffle, in turns of bounded size.
    """

    def run(batches):
        seen, held, size = _Words(), [], 0

        def counted():
            h, mark, known = (np.concatenate([x[i] for x in held]) for i in range(3))
            h, at = np.unique(h, return_inverse=True)
            some = np.bincount(at, known, len(h)) == 0
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.bincount(at, minlength=len(h))), pa.array(np.bincount(at, mark, len(h)).astype(np.int64), mask=some)], ["hash", "n", "marks"])

        for batch in batches:
            marks = batch.column(1)
            mark, known = marks.fill_null(0).to_numpy(zero_copy_only=False), marks.is_valid().to_numpy(zero_copy_only=False)
            for first, texts in _steps(batch, 0):
                words, text = seen.placed(texts)
                terms = list(seen.terms(words))
                h, of = (np.concatenate([x[there] for x, (_, there) in zip(y, terms, strict=True)]) for y in ([t for t, _ in terms], [text] * LONGEST))
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                h, of = h[new], of[new] + first
                held.append((h, mark[of], known[of]))
                size += len(h)
                if size > _HELD:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    rows = df.select(F.col(text_col), F.col(mark_col).cast("long")).mapInArrow(run, "hash long, n long, marks long")
    return rows.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("marks").alias("marks"))


def hashed_terms(lexicon: DataFrame) -> DataFrame:
    """(hash, weight) of a lexicon (term, weight); terms of more than LONGEST words match nothing and go."""

    def run(batches):
        seen = _Words()
        for batch in batches:
            hashes = []
            for t in batch.column(0).cast(pa.large_binary()).to_pylist():
                words, _ = seen.placed([t])
                n = len(words) - 2 * LONGEST
                whole = 0 < n <= LONGEST and b" ".join(t.translate(_BLANKED).lower().split()) == t
                hashes.append(int([h for h, _ in seen.terms(words)][n - 1][LONGEST]) if whole else None)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column(1)], ["hash", "weight"])

    return lexicon.select("term", F.col("weight").cast("double")).where("term is not null").mapInArrow(run, "hash long, weight double").where("hash is not null")


def rule_sentiment(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """(id, compound) of every row: x / sqrt(x^2 + 15) of the text's sum x.

    lexicon: distinct term (one to LONGEST lower-case words, a blank between) and weight,
    or hash and weight as term_counts and hashed_terms name terms. A term
    counts its weight, away from zero by CAPITALS if it is written in capitals in a
    text that is not all capitals; boosters up to three words ahead add or take BOOST,
    a negation there turns it; before the text's first "but" it counts half, after it
    one and a half. Exclamation and question marks add in the sum's direction. Null,
    empty and wordless texts score 0.
    """
    terms = lexicon if "hash" in lexicon.columns else hashed_terms(lexicon)
    terms = stored(terms.where("weight <> 0").select("hash", F.col("weight").cast("double").alias("weight")), "rule-lexicon")
    if terms.count() <= MOST_TERMS:
        return _by_broadcast(df, id_col, text_col, terms)
    return _by_groups(df, id_col, text_col, terms)


def _by_broadcast(df: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    told = df.sparkSession.sparkContext.broadcast(_sorted_lexicon(terms.toArrow()))  # MOST_TERMS rows at most
    discard(terms)

    def run(batches):
        seen = _Words()
        for batch in batches:
            for first, texts in _steps(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(_scores(texts, seen, *told.value))], ["id", "compound"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, compound double").withColumnRenamed("id", id_col)


def _by_groups(df: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """Texts are dealt into groups of about GROUP_BYTES; each asks the lexicon for its distinct terms and is scored by those found."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    groups = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES))
    dealt = rows.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).alias("part"))

    def asked(part: pa.Table) -> pa.Table:
        seen, found = _Words(), [np.zeros(0, np.int64)]
        for batch in part.to_batches():
            for _, texts in _steps(batch, 1):
                words, _ = seen.placed(texts)
                found.append(np.unique(np.concatenate([h[there] for h, there in seen.terms(words)])))
        hashes = np.unique(np.concatenate(found))
        return pa.table({"part": pa.array(np.full(len(hashes), part["part"][0].as_py()), pa.int64()), "hash": pa.array(hashes)})

    def scored(part: pa.Table, answers: pa.Table) -> pa.Table:
        seen, lexicon = _Words(), _sorted_lexicon(answers)
        ids, found = part["id"], [np.zeros(0)]
        for batch in part.to_batches():
            found += [_scores(texts, seen, *lexicon) for _, texts in _steps(batch, 1)]
        return pa.table({"id": ids, "compound": pa.array(np.concatenate(found))})

    answers = dealt.groupBy("part").applyInArrow(asked, "part long, hash long").join(terms, "hash").select("part", "hash", "weight")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, compound double"
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(scored, schema).withColumnRenamed("id", id_col)
