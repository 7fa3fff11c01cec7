"""Quality rules as a short-circuit cascade (DataFrame functions only)."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import BLANKS, discard, stored

#: Rows on which costs and rejections are estimated (about so many, at random; twice that at most), and timed runs of each rule.
SAMPLE_ROWS, RUNS = 1000, 3
#: What the dearest rule takes at least over the repeated sample, in seconds, and the most repeats.
LEAST_S, MOST_TIMES = 0.1, 256
_SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.filter(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long")


def n_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words in 8-word windows found twice or more in the text, the first included.

    Windows are compared by 64-bit hashes. A text without a repeated window stops
    after one distinct count; otherwise windows are sorted by hash, those with an
    equal neighbour are kept, and the union of their words is counted by position.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 7), lambda i: F.xxhash64(F.slice(words, i, F.lit(8))))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def twice(s: Column) -> Column:
            return F.transform(F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])), lambda x: x["i"])
        def counted(at: Column) -> Column:
            return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(8), i - acc["last"])).cast("long").alias("n"), i.alias("last")), lambda acc: acc["n"])
        return _let(ordered, lambda s: _let(F.array_sort(twice(s)), counted))

    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < 9, F.lit(0).cast("long")).otherwise(found)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: name -> when a text is rejected. Thresholds follow published web-text rules, wide enough for clean prose.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda t: n_words(t) < 20,
    "symbols": lambda t: n_symbols(t) * 10 > n_words(t) * 3,
    "word_length": lambda t: (word_chars(t) > 25 * n_words(t)) | (word_chars(t) < 2 * n_words(t)),
    "dup_lines": lambda t: n_dup_lines(t) * 10 > 3 * F.size(F.split(t, "\n", -1)),
    "letters": lambda t: n_letters(t) * 10 < word_chars(t) * 6,
    "repeat_words": lambda t: _let(words_of(t), lambda w: 100 * n_repeat_words(w) > 30 * F.size(w)),
}


@dataclass
class Step:
    """A rule in its place: seconds a row, and the shares of all rows that it is run on and of those that it rejects."""

    name: str
    cost: float
    evaluated: float
    rejects: float


def plan_cascade(docs: DataFrame, rules: dict[str, Column], prepare: Callable[[DataFrame], DataFrame] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[Step]:
    """The rules, each next one with the most rejections per second among the rows that those before it let pass.

    Estimated on a random sample of about ``sample_rows`` rows, written once as the
    rules will find them: after ``prepare``, which adds what is worked out anyway. One
    aggregate counts rows by the set of rules that reject them, which gives every
    conditional rejection; each rule then runs alone, over the sample so many times
    over that the dearest takes LEAST_S. Costs count in halves of the dearest, down to a
    sixteenth, below which a clock sees noise; so runs agree. The sample settles only the order: the verdict is the same in any.
    Equal ranks go by name; without rows the rules stay as they are.
    """
    rows = docs.count()
    if not rows:
        return [Step(name, 0.0, 0.0, 0.0) for name in rules]
    drawn = docs.sample(min(1.0, sample_rows / rows), 7).limit(2 * sample_rows)
    sample = stored((prepare(drawn) if prepare else drawn).coalesce(1), "rule-sample")
    names = list(rules)
    mask = reduce(lambda x, y: x.bitwiseOR(y), [F.when(rules[n], 1 << i).otherwise(0) for i, n in enumerate(names)])
    sets = {r.mask: r.n for r in sample.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 ** rules at most

    def timed(times: int, runs: int, *rule: Column) -> float:
        job = sample.withColumn("qr_again", F.explode(F.sequence(F.lit(1), F.lit(times)))).agg(F.count("qr_again"), *[F.count_if(r) for r in rule])
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            job.first()
            took.append(time.perf_counter() - began)
        return min(took)

    once = {n: timed(1, 2, rules[n]) for n in names}
    times = min(MOST_TIMES, max(1, math.ceil(LEAST_S / max(max(once.values()) - timed(1, 2), 1e-3))))
    scan = timed(times, RUNS)
    spent = {n: max(timed(times, RUNS, rules[n]) - scan, 0.0) for n in names}
    discard(sample)
    dearest, total = max(max(spent.values()), 1e-9), max(sum(sets.values()), 1)
    cost = {n: dearest * 2.0 ** max(round(math.log2(max(spent[n] / dearest, 1e-9))), -4) / (times * total) for n in names}
    out: list[Step] = []
    while len(out) < len(names):
        left = sum(sets.values())
        hit = {n: sum(c for m, c in sets.items() if m >> i & 1) for i, n in enumerate(names) if n not in {s.name for s in out}}
        best = min(hit, key=lambda n: (-(hit[n] + 0.5) / (left + 1) / cost[n], n))
        out.append(Step(best, cost[best], left / total, hit[best] / left if left else 0.0))
        sets = {m: c for m, c in sets.items() if not m >> names.index(best) & 1}
    return out


def cascade_order(docs: DataFrame, text_col: str = "text", rules: dict[str, Callable[[Column], Column]] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of rules on a text in the order of their cascade."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return [s.name for s in plan_cascade(texts, {n: rule(F.col("t")) for n, rule in (rules or RULES).items()}, sample_rows=sample_rows)]


def rejected_by(text: Column, order: list[str], rules: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The first rule that rejects, else null; CASE stops there, so later rules cost nothing."""
    rules = rules or RULES
    out = None
    for name in order:
        out = F.when(rules[name](text), F.lit(name)) if out is None else out.when(rules[name](text), F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows that pass every rule, with their columns as they were, whatever their names.

    Rules run in the cascade's order, each only on what those before it let pass. A
    null text counts as empty and is rejected, as is a blank one. A text of any length
    is read whole. Repeated rows share one fate; an empty table gives an empty result.
    """
    order = cascade_order(docs, text_col)
    return docs.where(rejected_by(F.coalesce(F.col(text_col), F.lit("")), order).isNull())


def measure_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's counts, base verdict and cascade verdict; other columns are ignored, whatever their names.

    The counts are part of the result, so rules on them cost nothing more here; the
    others run in the cascade's order, on rows that no rule before has rejected. A null
    text counts as empty: all counts 0, base_failed. A text of any length is read
    whole. Repeated rows each get a row; ties cannot occur. An empty table gives an
    empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def counts(rows: DataFrame) -> DataFrame:
        split = rows.select("id", "t", words_of(F.col("t")).alias("w"))
        return split.select(
            "id", "t", F.size("w").cast("long").alias("n_words"), word_chars(F.col("t")).alias("word_chars"), n_symbols(F.col("t")).alias("n_symbols"),
            n_dup_lines(F.col("t")).alias("n_dup_lines"), n_repeat_words(F.col("w")).alias("n_repeat_words"), F.size(F.split("t", "\n", -1)).alias("n_lines"),
        )

    counted = counts(base)
    # the rules on columns already counted; the two of base_failed come first
    known = {
        "symbols": F.col("n_symbols") * 10 > F.col("n_words") * 3,
        "word_length": (F.col("word_chars") > 25 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")),
        "dup_lines": F.col("n_dup_lines") * 10 > 3 * F.col("n_lines"),
        "letters": n_letters(F.col("t")) * 10 < F.col("word_chars") * 6,
    }
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # estimated as they run: beside the counts, on the rows that base_failed lets pass
    order = [step.name for step in plan_cascade(base, known, lambda rows: counts(rows).where(~failed))]
    verdict = rejected_by(F.lit(None), order, {k: lambda _, v=v: v for k, v in known.items()})
    out = counted.withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict.isNull()))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
