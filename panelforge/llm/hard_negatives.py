"""Hard negatives by a full score sort per anchor.

Every anchor meets every block of rows twice. First its best rows of the same label
are found: its positives. Then each block is scored again and sorted by (score, id);
for each positive a binary search finds the upper limit in the sorted scores of the
other labels, and the next entries are read while they stay above the lower limit.
Sorted blocks are runs of the anchor's whole sort, so the first of each block hold
the first of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import discard, stored
from panelforge.llm.vector_blocks import BLOCK_ROWS, GROUP_ROWS, LONG, Blocks, entries, scores, unpack


def spread_label(id_: Column, label: Column, modulus: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one of ``labels`` where the id is divisible by ``modulus``."""
    return F.when(F.pmod(id_, F.lit(modulus)) == 0, F.pmod(label.cast("long") + 1, F.lit(labels))).otherwise(label.cast("long"))


def _sorted_by_score(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions from the highest score down, ties from the smallest id up."""
    return np.lexsort((ids, ~score))  # ~s = -s - 1 has no overflow


def _positives(k: int):
    def run(dim: int, block: pa.Table, group: pa.Table) -> pa.Table:
        ids, labels, rows = unpack(block, dim)
        own, own_labels, asked = unpack(group, dim)
        out = []
        for label in np.unique(own_labels):
            here, there = np.flatnonzero(own_labels == label), np.flatnonzero(labels == label)
            for a, score in zip(here, scores(asked[here], rows[there]), strict=True):
                order = _sorted_by_score(score, ids[there])
                order = order[ids[there][order] != own[a]][:k]
                out.append((np.full(len(order), own[a]), ids[there][order], score[order]))
        return _table(out, ("anchor_id", "positive_id", "positive_score"))

    return run


def _limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the highest negative score: low * score <= 100 * negative <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(k: int, low: int, high: int):
    def run(dim: int, block: pa.Table, group: pa.Table) -> pa.Table:
        ids, labels, rows = unpack(block, dim)
        own, own_labels, asked = unpack(group, dim)
        more = group["more"][0].as_py()
        out = []
        for label in np.unique(own_labels):
            here, there = np.flatnonzero(own_labels == label), np.flatnonzero(labels != label)
            for a, score in zip(here, scores(asked[here], rows[there]), strict=True):
                order = _sorted_by_score(score, ids[there])
                falling = ~score[order]  # ascending
                for positive, reached in more[a]:
                    least, most = _limits(reached, low, high)
                    start = np.searchsorted(falling, ~min(most, LONG), "left")
                    take = order[start : start + k]
                    take = take[score[take] >= least]
                    out.append((np.full(len(take), own[a]), np.full(len(take), positive), ids[there][take], np.full(len(take), reached), score[take]))
        return _table(out, ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"))

    return run


def _table(parts: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = zip(*parts, strict=True) if parts else [[np.zeros(0, np.int64)]] * len(names)
    return pa.table({n: pa.array(np.concatenate(list(x)), pa.int64()) for n, x in zip(names, columns, strict=True)})


def mine(vectors: DataFrame, label: Column, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """For each anchor (id divisible by ``every``) and each of its first positives of the same label, the first k rows of other labels between the limits.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    Components x become floor(256 * x); scores are integer inner products, higher first,
    ties by smaller id; a negative's score is from low to high hundredths of the
    positive's. Rows with a null id or label, and vectors that are null or hold null or
    non-finite components, take no part; only vectors of one length are compared. An id
    that repeats is one row, the one with the least (label, vector). Pairs without a
    negative between the limits give no row, as do anchors without positives and an
    empty table. Other columns are ignored, whatever their names. A component beyond 32
    bits and a score beyond 64 count as those limits.
    """
    blocks = Blocks(entries(vectors, id_col, vector_col, label), every, block_rows, group_rows)
    nearest = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    pairs = blocks.meet(_positives(positives), "anchor_id long, positive_id long, positive_score long").withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= positives)
    # at most ``positives`` pairs an anchor
    chosen = stored(pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.array("positive_id", "positive_score")).alias("more")), "negatives-pairs")
    found = blocks.meet(_negatives(k, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", chosen)
    hardest = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= k)
    out = stored(ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives-result")
    discard(chosen, *blocks.written())
    return out
