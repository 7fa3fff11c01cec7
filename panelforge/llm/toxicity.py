"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import discard, fit_logistic, held_out, labelled_sample, stored

PER_CLASS = 6000
STEMS = (4, 5, 6)
MIN_DOCS = 4
MIN_WEIGHT = 2.5

# General insults that start the lexicon, one weight for all.
SEEDS = ["idiot", "moron", "loser", "stupid", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard", "asshole", "bitch", "whore", "slut", "retard", "faggot", "fuck", "shit", "cunt"]
SEED_WEIGHT = 3.0

# Phrases in which an entry is harmless.
EXCEPTIONS = ["trash can", "trash bin", "clown fish", "pond scum", "stupid question", "circus clown", "trash collection"]

# Look-alike letters and digits, one character for one.
_LOOK_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ո": "n", "ɑ": "a", "α": "a", "ο": "o", "ι": "i", "ν": "v", "τ": "t", "κ": "k", "ρ": "p", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h"}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_FOLD = str.maketrans(_LOOK_ALIKE | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_DIGIT_FOLD = str.maketrans(_DIGITS)
_WORD = re.compile(r"\w+")
#: A run of letters, digits and signs with a digit or sign that may stand for a letter; one scan, no backtracking.
_BROKEN = re.compile(r"(?<![\w@$!])[^\W013457]*+[013457@$!][\w@$!]*+")


def _mend(m: re.Match) -> str:
    core = m[0].rstrip("!")
    return core.translate(_DIGIT_FOLD) + m[0][len(core) :] if sum(map(str.isalpha, core)) >= 2 else m[0]


def fold(text: str) -> tuple[str, str]:
    """Lower case with look-alike letters as Latin ones; and the same with digits and signs, in words of two letters
    or more, as the letters they stand for. Both are equally long, so that a place in one is that in the other."""
    text = text.lower()
    text = text if text.isascii() else text.translate(_FOLD)
    return text, _BROKEN.sub(_mend, text)


@dataclass
class Lexicon:
    """entries: word -> weight; a word ending in * is a stem that words may start with."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    weights: tuple[float, ...] = (-4.0, 2.0, 0.0)

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            stem = entry.endswith("*")
            auto.add_word(entry.rstrip("*"), (len(entry.rstrip("*")), weight, stem))
        for phrase in self.exceptions:
            old = auto.get(phrase, None)
            if old is None:
                auto.add_word(phrase, (len(phrase), None, False))
        if len(auto):
            auto.make_automaton()
        return auto

    def hits(self, raw: str, auto) -> dict[int, float]:
        """Where a match begins, outside exception phrases -> the largest weight of those that begin there, in either folded form."""
        hits: dict[int, float] = {}
        excused = []
        plain, mended = fold(raw)
        for text in (plain, mended) if mended != plain else (plain,):
            for end, (size, weight, stem) in auto.iter(text):
                begin = end - size + 1
                if begin and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
                    continue
                if not stem and end + 1 < len(text) and (text[end + 1].isalnum() or text[end + 1] == "_"):
                    continue
                if weight is None:
                    excused.append((begin, end))
                else:
                    hits[begin] = max(weight, hits.get(begin, 0.0))
        if not excused or not hits:
            return hits
        starts, ends = [], []
        for lo, hi in sorted(excused):
            if ends and lo <= ends[-1]:
                ends[-1] = max(ends[-1], hi)
            else:
                starts.append(lo)
                ends.append(hi)
        return {b: w for b, w in hits.items() if (i := bisect_right(starts, b) - 1) < 0 or b > ends[i]}

    def features(self, texts, auto) -> np.ndarray:
        """Per text: summed weight of the matches outside exception phrases by its square-root length, and by its length."""
        out = np.zeros((len(texts), 2))
        for row, raw in enumerate(texts):
            if raw and len(auto) and (hits := self.hits(raw, auto)):
                words = 1 + raw.count(" ") + raw.count("\n")
                total = sum(hits.values())
                out[row] = total / math.sqrt(words + 9), total / (words + 9)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        z = a + b * np.log1p(10 * features[:, 0]) + c * np.log1p(100 * features[:, 1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _terms(batches):
    """(term, label, documents) of the sample: folded words and stems, each once a document."""
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            plain, mended = fold(text)
            words = set(_WORD.findall(plain))
            if mended != plain:
                words.update(_WORD.findall(mended))
            counts[label].update(words)
            counts[label].update({w[:k] + "*" for w in words for k in STEMS if len(w) >= k})
            counts[label][""] += 1
    for label, found in counts.items():
        terms = list(found)
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([label] * len(part), pa.int32()), pa.array([found[t] for t in part], pa.int64())], ["term", "label", "n"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, modulus: int = 5, remainder: int = 0) -> Lexicon:
    """Learn the lexicon and its calibration from a bounded labelled sample outside the held-out remainder.

    The sample holds at most per_class rows of each label, of whole texts. An entry's
    weight is its smoothed log ratio of document shares; every term of MIN_DOCS bad
    documents and MIN_WEIGHT is an entry, but stems that say no more than a shorter
    stem are left out. Null and empty texts have no terms; repeated ids give one row.
    Without labels of both kinds, or on empty tables, the seeds stand alone. Terms tie
    by name.
    """
    sample = stored(labelled_sample(docs, labels, "toxic", per_class, modulus=modulus, remainder=remainder).select("text", "label"), "toxic-sample")
    terms = sample.mapInArrow(_terms, "term string, label int, n long")
    counted = stored(terms.groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good")), "toxic-terms")
    entries = dict.fromkeys(SEEDS, SEED_WEIGHT)
    size = next(((r.bad, r.good) for r in counted.where("term = ''").collect()), (0, 0))
    if not size[0] or not size[1]:
        discard(sample, counted)
        return Lexicon(entries)
    weight = F.log((F.col("bad") + 0.5) / (size[0] + 1)) - F.log((F.col("good") + 0.5) / (size[1] + 1))
    # what is left are the lexicon's candidates: at most a MIN_DOCS-th of the terms of per_class documents
    wanted = counted.where((F.col("term") != "") & (F.col("bad") >= MIN_DOCS)).withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT).orderBy("term").collect()
    found = {r.term: r.weight for r in wanted}
    # a stem stays only where several words share it: otherwise its commonest word or longer stem says as much
    docs_of = {r.term: r.bad for r in wanted}
    longer = Counter()
    for term, n in docs_of.items():
        word = term.rstrip("*")
        for k in STEMS:
            if len(word) > k or (len(word) == k and not term.endswith("*")):
                longer[word[:k] + "*"] = max(longer[word[:k] + "*"], n)
    found = {t: w for t, w in found.items() if longer[t] < 0.9 * docs_of[t]}
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"))):
        word = term.rstrip("*")
        if all(found[term] > kept.get(word[:k] + "*", -9.0) + 0.7 for k in range(1, len(word) + 1)):
            kept[term] = found[term]
    for term in sorted(kept):
        if term.endswith("*"):
            entries.pop(term[:-1], None)
        entries[term] = kept[term]
    lexicon = Lexicon(entries)
    both = sample.mapInArrow(_feature_rows(lexicon), "f1 double, f2 double, label int").collect()
    discard(sample, counted)
    x = np.array([[1.0, math.log1p(10 * r.f1), math.log1p(100 * r.f2)] for r in both])
    y = np.array([r.label for r in both], float)
    lexicon.weights = tuple(float(w) for w in fit_logistic(x, y, ridge=0.1))
    return lexicon


def _feature_rows(lexicon: Lexicon):
    def run(batches):
        auto = lexicon.automaton()
        for batch in batches:
            f = lexicon.features(batch.column(0).to_pylist(), auto)
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), batch.column(1)], ["f1", "f2", "label"])

    return run


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0) -> DataFrame:
    """id, held_out, score and predicted (score >= 0.5) of every row; one pass, no shuffle.

    A null text counts as empty and scores as one without matches. A null id is not
    held out. A text of any length is read whole, in time proportional to it. Repeated
    rows each get a row; ties cannot occur. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        auto = lexicon.automaton()
        for batch in batches:
            score = lexicon.score(lexicon.features(batch.column(2).to_pylist(), auto))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), modulus, remainder).alias("held"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def filter_documents(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """Rows that score under 0.5, with their columns as they were, whatever their names.

    A null or empty text counts as one without matches. Long texts are read whole;
    repeated rows share one fate; an empty table gives an empty result.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def run(batches):
        auto = lexicon.automaton()
        for batch in batches:
            score = lexicon.score(lexicon.features(batch.column(at).to_pylist(), auto))
            yield batch.filter(pa.array(score < 0.5))

    kept = docs.toDF(*own).mapInArrow(run, ", ".join(f"{c} {kind}" for c, (_, kind) in zip(own, docs.dtypes, strict=True)))
    return kept.toDF(*docs.columns)
