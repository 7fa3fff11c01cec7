"""Integer vectors in blocks: a stated set of asking rows against all rows.

Rows are dealt by a hash of their id to blocks of bounded size, asking rows to groups
of bounded size; both are packed into one record each, and a task gets one block with
one group. Nothing is broadcast, and what a task holds does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import default_partitions, stored

BLOCK_ROWS, GROUP_ROWS = 8192, 1024
#: Scores beyond a long's range count as its limits.
LONG = 2**63 - 1
_LIMIT = float(2**31 - 1)


def steps_of(x: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; beyond a signed 32-bit number it counts as that limit."""
    return F.transform(x.cast("array<double>"), lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(_LIMIT)), F.lit(-_LIMIT))).cast("int"))


def whole(x: Column) -> Column:
    """True for a vector without null or non-finite components."""
    return x.isNotNull() & F.coalesce(F.forall(x.cast("array<double>"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))


def entries(vectors: DataFrame, id_col: str, vector_col: str, label: Column | None = None, scale: int = 256) -> DataFrame:
    """(id, label, v, dim): one row an id, its least (label, vector); label is 0 where none is given."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"), F.col(vector_col).alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole(F.col("x"))).select("id", "label", steps_of(F.col("x"), scale).alias("v"))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("one"))
    return one.select("id", "one.label", "one.v", F.size("one.v").alias("dim"))


def _pack(keys: list[str]):
    """One record a group: ids in order, labels and components as raw bytes."""

    def run(key, rows):
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = np.asarray(flat, np.int32).reshape(len(order), -1)[order]
        raw = {"ids": rows["id"].to_numpy()[order], "labels": rows["label"].to_numpy()[order], "steps": v}
        extra = {"more": pa.array([rows["more"].take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.list_(pa.int64()))))} if "more" in rows.column_names else {}
        return pa.table({**{k: pa.array([x.as_py()], x.type) for k, x in zip(keys, key, strict=True)}, **{n: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for n, x in raw.items()}, **extra})

    return run


_RAW = "ids binary, labels binary, steps binary"


def unpack(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and components of a packed record."""
    ids, labels = (np.frombuffer(table[n][0].as_py(), np.int64) for n in ("ids", "labels"))
    return ids, labels, np.frombuffer(table["steps"][0].as_py(), np.int32).reshape(len(ids), dim)


class Blocks:
    """Blocks of all rows and groups of the asking ones; index_fields names what ``index`` adds to a block."""

    def __init__(self, rows: DataFrame, every: int, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, index: Callable | None = None, index_fields: str = ""):
        self.rows = stored(rows, "vectors")
        self.asking = self.rows.where(F.pmod("id", F.lit(every)) == 0)
        spark = rows.sparkSession
        sizes = self.rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.pmod("id", F.lit(every)) == 0).alias("asked")).where("asked > 0")
        #: A row for each vector length, with its numbers of blocks and groups.
        self.parts = stored(sizes.select("dim", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), F.ceil(F.col("asked") / group_rows).cast("int").alias("groups")), "vector-parts")
        dealt = self.rows.join(self.parts, "dim").select("dim", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "label", "v")
        pack = _pack(["dim", "block"])
        build = pack if index is None else (lambda key, rows: index(key[0].as_py(), pack(key, rows)))
        fields = f"dim int, block int, {_RAW}" + (f", {index_fields}" if index_fields else "")
        self.index = stored(dealt.repartition(default_partitions(spark), "dim", "block").groupBy("dim", "block").applyInArrow(build, fields), "vector-blocks")

    def meet(self, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str, more: DataFrame | None = None) -> DataFrame:
        """fn(dim, block, group) for every block with every group of asking rows; more: (id, more array<array<long>>) that goes along with them."""
        spark = self.rows.sparkSession
        n = default_partitions(spark)
        asking = self.asking.join(self.parts, "dim").select("dim", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("grp"), "id", "label", "v")
        raw = _RAW
        if more is not None:
            asking, raw = asking.join(more, "id"), f"{_RAW}, more array<array<array<long>>>"
        packed = asking.groupBy("dim", "grp").applyInArrow(_pack(["dim", "grp"]), f"dim int, grp int, {raw}")
        asked = packed.join(self.parts, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "groups")
        blocks = self.index.join(self.parts, "dim").withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("blocks", "groups")
        keys = ["dim", "block", "grp"]

        def run(key, block, group):
            return fn(key[0].as_py(), block, group) if block.num_rows and group.num_rows else empty

        empty = _empty(schema)
        return blocks.repartition(n, *keys).groupBy(*keys).cogroup(asked.repartition(n, *keys).groupBy(*keys)).applyInArrow(run, schema)

    def written(self) -> list[DataFrame]:
        """The tables to discard in the end."""
        return [self.rows, self.parts, self.index]


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.table({n: pa.array([], kinds[k]) for n, k in (x.split() for x in schema.split(", "))})


def scores(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products (asked, rows), exact; beyond a long's range its limits."""
    most = lambda x: int(np.abs(x.astype(np.int64)).max(initial=0))
    bound = most(asked) * most(rows) * max(asked.shape[1], 1)
    if bound < 2**53:
        return (asked.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound <= LONG:
        return asked.astype(np.int64) @ rows.astype(np.int64).T
    exact = asked.astype(object) @ rows.astype(object).T
    return np.vectorize(lambda s: min(max(s, -LONG - 1), LONG), otypes=[np.int64])(exact).reshape(exact.shape)
