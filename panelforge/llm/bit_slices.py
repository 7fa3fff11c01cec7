"""Exact top-k by inner product over a bit-sliced index.

Components are whole numbers. In a block, each attribute is moved to start at zero and
its highest bits are kept as slices: one bitmap of the block's rows for each bit. A
query adds the slices of all attributes, each as often as its weight has bits, with
carry-save adders on bitmaps (a negative weight takes the complement). The sum is
again a set of slices; read from the most significant one downward they give the k-th
largest lower bound without a score for any single row. Rows that the low bits left
out could still lift to that bound are the boundary rows; they alone are scored from
their components, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import discard, stored
from panelforge.llm.vector_blocks import BLOCK_ROWS, GROUP_ROWS, Blocks, entries, scores, unpack

#: Bits of an attribute that the index keeps, from the highest down.
SLICES = 6


def slice_rows(steps: np.ndarray, slices: int = SLICES) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps (attribute, bit from low to high, words) of the highest bits, the attributes' least values, and the number of bits left out."""
    low = steps.min(0).astype(np.int64)
    shifted = steps.astype(np.int64) - low
    drop = max(0, int(shifted.max(initial=0)).bit_length() - slices)
    coarse = (shifted >> drop).astype(np.uint64)
    bits = (coarse.T[:, None, :] >> np.arange(slices, dtype=np.uint64)[None, :, None]) & np.uint64(1)
    packed = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")
    words = -(-len(steps) // 64)
    out = np.zeros((*packed.shape[:2], words * 8), np.uint8)
    out[:, :, : packed.shape[2]] = packed
    return out.view(np.uint64), low, drop


def add_slices(bitmaps: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Slices, low to high, of sum(|w| * attribute), an attribute with a negative weight complemented."""
    dims, slices, words = bitmaps.shape
    signed = np.where(weights < 0, np.uint64(2**64 - 1), np.uint64(0))[:, None, None] ^ bitmaps
    flat, size = signed.reshape(dims * slices, words), np.abs(weights.astype(np.int64))
    of_bit = [np.flatnonzero(size >> j & 1) * slices for j in range(int(size.max(initial=0)).bit_length())]
    out, carries, weight = [], [], 0
    while weight < slices + len(of_bit) - 1 or carries:
        terms = [at + weight - j for j, at in enumerate(of_bit) if 0 <= weight - j < slices and len(at)]
        column = np.concatenate([flat[np.concatenate(terms)] if terms else flat[:0], *carries])
        carries = []
        while len(column) > 1:
            third = len(column) // 3
            if third:
                a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                column = np.concatenate((half ^ c, column[3 * third :]))
            else:
                carries.append((column[:1] & column[1:]))
                column = column[:1] ^ column[1:]
        out.append(column[0] if len(column) else np.zeros(words, np.uint64))
        weight += 1
    return out


def kth_largest(sums: list[np.ndarray], valid: np.ndarray, k: int) -> int:
    """The k-th largest sum of the valid rows, read from the highest slice down; 0 if there are fewer rows."""
    tied, above, value = valid, 0, 0
    for s in reversed(sums):
        value <<= 1
        ones = tied & s
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            tied, value = ones, value | 1
        else:
            above += n
            tied = tied & ~s
    return value


def at_least(sums: list[np.ndarray], valid: np.ndarray, least: int) -> np.ndarray:
    """The bitmap of valid rows whose sum is least or more."""
    if least <= 0:
        return valid
    if least.bit_length() > len(sums):
        return np.zeros_like(valid)
    above, tied = np.zeros_like(valid), valid
    for i in range(len(sums) - 1, -1, -1):
        if least >> i & 1:
            tied = tied & sums[i]
        else:
            above |= tied & sums[i]
            tied = tied & ~sums[i]
    return above | tied


def _all_rows(n: int) -> np.ndarray:
    bits = np.zeros(-(-n // 64) * 64, np.uint8)
    bits[:n] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def boundary(bitmaps: np.ndarray, drop: int, valid: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows that can be among the k largest: their upper bound reaches the k-th largest lower bound."""
    sums = add_slices(bitmaps, weights)
    # what the left-out bits can add, in units of the lowest slice
    slack = ((2**drop - 1) * int(np.abs(weights.astype(np.int64)).sum())) >> drop
    found = at_least(sums, valid, kth_largest(sums, valid, k) - slack)
    return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))


def _build(dim: int, block: pa.Table) -> pa.Table:
    bitmaps, _, drop = slice_rows(unpack(block, dim)[2])
    return block.append_column("slices", pa.array([bitmaps.tobytes()], pa.binary())).append_column("dropped", pa.array([drop], pa.int32()))


_FOUND = "query_id long, vec_id long, score long"


def _search(k: int):
    def run(dim: int, block: pa.Table, group: pa.Table) -> pa.Table:
        ids, _, rows = unpack(block, dim)
        asked_ids, _, asked = unpack(group, dim)
        bitmaps = np.frombuffer(block["slices"][0].as_py(), np.uint64).reshape(dim, SLICES, -(-len(ids) // 64))
        drop, valid = block["dropped"][0].as_py(), _all_rows(len(ids))
        found = []
        for own, q in zip(asked_ids, asked, strict=True):
            at = boundary(bitmaps, drop, valid, q, k + 1)  # its own row may be among them
            at = at[ids[at] != own]
            score = scores(q[None, :], rows[at])[0]
            best = np.argsort(-score.astype(object) if score.size and score.min() == -(2**63) else -score, kind="stable")[:k]  # ids ascend, so ties go to the smaller
            found.append((np.full(len(best), own), ids[at][best], score[best]))
        return pa.table({n: pa.array(np.concatenate(x), pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), zip(*found, strict=True), strict=True)})

    return run


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The k highest integer inner products of every row whose id is divisible by ``every``, over all other rows; exact.

    Returns query_id, rank, vec_id, score. Components x become floor(256 * x). Rows with
    a null id, and vectors that are null or hold null or non-finite components, take no
    part; only vectors of one length are compared (empty ones score 0). An id that
    repeats is one row, the one with the least vector. Ties go to the smaller id. Fewer
    than k candidates give fewer rows, an empty table none. Other columns are ignored,
    whatever their names. A component beyond 32 bits and a score beyond 64 count as
    those limits.
    """
    blocks = Blocks(entries(vectors, id_col, vector_col), every, block_rows, group_rows, _build, "slices binary, dropped int")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = blocks.meet(_search(k), _FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = stored(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "slices-result")
    discard(*blocks.written())
    return out
