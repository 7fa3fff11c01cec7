"""A linear model of three classes over hashed words, for batched scoring of texts.

The words of a text are cut at white space, with A-Z lower-cased and marks at their
ends taken off; a word's bucket is the first four hex digits of its MD5. A text is the
set of its buckets. A class's weight of a bucket is the log odds ratio of the bucket
inside and outside the class, shrunk by its own z: ratios that few texts support, or
that are near one, weigh next to nothing. So fitting is one count by bucket and class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("positive", "negative", "neutral")
BUCKETS = 65_536  # four hex digits
UPPER, LOWER, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", ".,!?"
FIT_ROWS = 200_000  # labelled rows that a fit takes at most
HALF, SHRINK = 0.5, 30.0  # added to every count; z squared at which a ratio counts by half
_FOLD = str.maketrans(UPPER, LOWER)


def word_buckets(text: Column) -> Column:
    """The distinct buckets of a text's words; none for null and blank texts."""
    words = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    bare = F.filter(F.array_distinct(F.transform(words, lambda w: F.btrim(w, F.lit(MARKS)))), lambda w: w != "")
    return F.array_distinct(F.transform(bare, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int")))


@dataclass(frozen=True)
class TextModel:
    """Weights by (bucket, class) and what each class starts from: 1.5 MB, whatever the texts."""

    weights: np.ndarray
    start: np.ndarray

    def loader(self, df: DataFrame) -> Callable:
        """What scorer_udf takes: texts -> logits. The weights are broadcast."""
        sent = df.sparkSession.sparkContext.broadcast((self.weights, self.start))

        def load():
            weights, start = sent.value

            @lru_cache(maxsize=200_000)
            def bucket(word: str) -> int:
                return int(hashlib.md5(word.encode()).hexdigest()[:4], 16)

            def logits(texts: list[str]) -> np.ndarray:
                out = np.empty((len(texts), len(CLASSES)))
                for i, text in enumerate(texts):
                    words = {w.strip(MARKS) for w in _ascii_words(text.translate(_FOLD))} - {""}
                    out[i] = start + weights[sorted({bucket(w) for w in words})].sum(0)
                return out

            return logits

        return load


def _ascii_words(text: str) -> list[str]:
    """Words between ASCII white space alone; str.split() would also cut at other spaces."""
    return text.translate(_SPACES).split(" ")


_SPACES = dict.fromkeys(range(0x09, 0x0E), " ")


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, rows: int = FIT_ROWS) -> DataFrame:
    """docs with the labels of at most `rows` ids, those of the least hash (all labels, where there are fewer).

    The chosen labels are so few that they are broadcast, and texts are never shuffled.
    """
    chosen = labels.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return docs.join(F.broadcast(chosen), id_col)


def bucket_counts(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(bucket, positive, negative, neutral): texts of each class that hold the bucket. One shuffle of at most BUCKETS rows a task."""
    rows = labelled.select(F.col(label_col).alias("label"), F.explode(word_buckets(F.col(text_col))).alias("bucket"))
    return rows.groupBy("bucket").agg(*[F.count_if(F.col("label") == c).alias(c) for c in CLASSES])


def shrunk_log_odds(inside: np.ndarray, n_inside: float, outside: np.ndarray, n_outside: float) -> np.ndarray:
    """Log odds ratio d of being in a text, times z^4 / (z^4 + SHRINK^2), where z^2 = d^2 / variance."""
    d = np.log((inside + HALF) / (n_inside - inside + HALF)) - np.log((outside + HALF) / (n_outside - outside + HALF))
    z2 = d * d / (1 / (inside + HALF) + 1 / (outside + HALF))
    return d * z2 * z2 / (z2 * z2 + SHRINK * SHRINK)


def fit_text_model(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> TextModel:
    """Fit on rows with a label among CLASSES; others are left out.

    Null and blank texts count among the texts of their class and hold no bucket;
    repeated rows each count. Without rows every class has the same probability. What
    reaches the driver is a row for each bucket.
    """
    rows = labelled.where(F.col(label_col).isin(*CLASSES))
    totals = rows.agg(*[F.count_if(F.col(label_col) == c).alias(c) for c in CLASSES]).first()
    n = np.array([totals[c] for c in CLASSES], float)
    held = np.zeros((BUCKETS, len(CLASSES)))
    found = bucket_counts(rows, text_col, label_col).toPandas()
    held[found["bucket"].to_numpy(int)] = found[list(CLASSES)].to_numpy(float)
    rest = held.sum(1, keepdims=True) - held
    weights = np.column_stack([shrunk_log_odds(held[:, k], n[k], rest[:, k], n.sum() - n[k]) for k in range(len(CLASSES))])
    weights[held.sum(1) == 0] = 0.0
    return TextModel(weights, np.log((n + HALF) / (n.sum() + HALF * len(CLASSES))))
