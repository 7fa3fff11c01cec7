"""Shared plumbing of the corpus operators: the shared folder, written intermediates, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.storage import delete_path, discard, fresh_path, shared_dir, shuffles_removed, stored  # noqa: F401

#: The one-byte white space of every word contract here: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"


#: Operators that keep a row where its scan put it.
_NARROW = re.compile(r"^(Project|Filter|ColumnarToRow|FileScan|Scan|LocalTableScan|Range|Generate|\*|\(\d+\))")


def placed(docs: DataFrame) -> DataFrame:
    """docs, if each run deals its rows alike (a plain scan with narrow steps); else a written copy that does."""
    query = docs._jdf.queryExecution()
    lines = [x.lstrip(" :+-") for x in query.sparkPlan().toString().split("\n") if x.strip()]
    narrow = query.optimizedPlan().deterministic() and all(_NARROW.match(x) for x in lines)
    return docs if narrow else stored(docs, "placed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key has no remainder (null)."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """True where the key's remainder is the held-out one; a null key is never held out."""
    return F.coalesce(bucket_of(key, modulus) == remainder, F.lit(False))


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, skip: int = 0, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 0) -> DataFrame:
    """(id, text, label): at most per_class rows of each label, outside the held-out remainder; texts whole, of any length.

    The ids are the first by a hash after ``skip``; an id with contradicting labels
    counts as 1. Each id gives one row, of rows that repeat it the one with the least
    text (combined before the shuffle), so the number of rows is bounded whatever the
    input. A null text is empty.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & ~held_out(F.col("id"), modulus, remainder)).groupBy("id").agg(F.max("label").alias("label"))
    chosen = None
    for label in (0, 1):
        part = marked.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(skip + per_class)
        part = part.orderBy(F.xxhash64("id").desc(), F.col("id").desc()).limit(per_class) if skip else part
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 x per_class rows of an id and a label at most
    chosen = stored(chosen.select(F.col("id").alias("chosen_id"), "label"), "labelled")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), texts["id"] == F.col("chosen_id")).groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")


def fit_logistic(x, y, rounds: int = 50, ridge: float = 1e-3):
    """Weights of a small logistic regression by Newton steps; x has the constant column already."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w
