"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors of length one are projected on Gaussian directions and cut into cells; a
table's bucket is the tuple of its hashes' cells. The difference of two projections
is normal with the vectors' distance as its deviation, so for a neighbour at a given
distance each perturbed bucket has a known chance of holding it. A query visits
buckets in the order of that chance until all tables together reach the target. The
distance is the one that nearest neighbours have in these data, and the number of
hashes is the one with the least work, both fitted on a bounded sample.

Equal vectors are one entry with their smallest ids. Members of a bucket meet its
visitors in blocks of bounded size on both sides, where one matrix product ranks
them; only each block's best go on, are merged over tables, and are ranked by their
exact cosines.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import discard, stored

TABLES, WIDTH, SEED = 2, 1.5, 11
#: Numbers of hashes to choose from, and the most buckets that a query visits in a table.
HASHES, MOST_PROBES = (3, 4, 5, 6, 8, 10, 12), 600
#: The estimated chance to meet a neighbour at the fitted distance.
TARGET = 0.96
#: Rows whose neighbours are looked for in all rows to fit the distance, and rows on which work is estimated.
FIT_QUERIES, FIT_ROWS = 64, 2000
BLOCK_ROWS = 4096
#: Scores this near the last one of a block may still tie with it exactly.
_SLACK = 1e-9
_REACH = np.arange(-4, 5)


def _planes(dim: int, table: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, table])
    return rng.standard_normal((dim, max(HASHES)))[:, :hashes], rng.uniform(0, WIDTH, max(HASHES))[:hashes]


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _code(cells: np.ndarray) -> np.ndarray:
    """One number for a tuple of cells (of 12 hashes 5 bits each: unit vectors lie within 16 cells; a rarer one shares a bucket)."""
    out = np.zeros(cells.shape[:-1], np.int64)
    for i in range(cells.shape[-1]):
        out = out * 32 + ((cells[..., i] + 16) & 31)
    return out


_erf = np.vectorize(math.erf, otypes=[float])


def _below(x: np.ndarray) -> np.ndarray:
    """The normal distribution function."""
    return 0.5 * (1 + _erf(x / math.sqrt(2)))


def probes(unit: np.ndarray, hashes: int, distance: float, target: float, most: int = MOST_PROBES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per table (query, bucket) in the order of the chance to hold a neighbour at the distance, until the target is reached."""
    dim, n = unit.shape[1], len(unit)
    codes, masses = [], []
    for table in range(TABLES):
        a, b = _planes(dim, table, hashes)
        at = (unit @ a + b) / WIDTH
        cells = np.floor(at).astype(np.int64)
        spread = max(distance, 1e-3) / WIDTH
        low = (at - cells)[:, :, None]
        p = np.maximum(_below((_REACH + 1 - low) / spread) - _below((_REACH - low) / spread), 1e-300)
        cost, steps = np.zeros((n, 1)), np.zeros((n, 1, 0), np.int64)
        for i in range(hashes):  # of the best tuples of all hashes, the first i are among the best of the first i
            both = (cost[:, :, None] - np.log(p[:, None, i, :])).reshape(n, -1)
            keep = min(most, both.shape[1])
            best = np.argsort(both, axis=1, kind="stable")[:, :keep]
            cost = np.take_along_axis(both, best, 1)
            before = np.take_along_axis(steps, (best // len(_REACH))[:, :, None], 1)
            steps = np.concatenate((before, _REACH[best % len(_REACH)][:, :, None]), 2)
        codes.append(_code(cells[:, None, :] + steps))
        masses.append(np.cumsum(np.exp(-cost), 1))
    reached = 1 - np.prod([1 - np.minimum(m, 1) for m in masses], axis=0)
    enough = np.minimum((reached < target).sum(1) + 1, reached.shape[1])
    take = np.arange(reached.shape[1])[None, :] < enough[:, None]
    who = np.nonzero(take)[0]
    return [(who, code[take]) for code in codes]


def _vectors(packed) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in packed])


def _by_dim(batch):
    """(dimension, rows, unit vectors, hashes, distance) of a batch (key, vec, ids, hashes, distance)."""
    packed = batch.column(1).to_pylist()
    dims = np.array([len(v) // 8 for v in packed], np.int64)
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows, _unit(_vectors([packed[r] for r in rows])), batch.column(3)[int(rows[0])].as_py(), batch.column(4)[int(rows[0])].as_py()


_BUCKETS = "dim int, table int, bucket long, key binary, vec binary, ids array<long>"
_BUCKET_NAMES = ["dim", "table", "bucket", "key", "vec", "ids"]


def _bucketed(batch, rows, who, code, dim, table):
    """Rows of a batch (key, vec, ids), each in its buckets."""
    at = pa.array(rows[who])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), dim), pa.int32()), pa.array(np.full(len(code), table), pa.int32()), pa.array(code), *(batch.column(i).take(at) for i in range(3))], _BUCKET_NAMES)


def _indexed(batches):
    for batch in batches:
        for dim, rows, unit, hashes, _ in _by_dim(batch) if batch.num_rows else ():
            for table in range(TABLES):
                a, b = _planes(dim, table, hashes)
                yield _bucketed(batch, rows, np.arange(len(rows)), _code(np.floor((unit @ a + b) / WIDTH).astype(np.int64)), dim, table)


def _visiting(target: float, most: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for dim, rows, unit, hashes, distance in _by_dim(part):
                    for table, (who, code) in enumerate(probes(unit, hashes, distance, target, most)):
                        yield _bucketed(part, rows, who, code, dim, table)

    return run


def _unsure(target: float, most: int):
    """Keys of the vectors whose visits end before they reach the target."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for _, rows, unit, hashes, distance in _by_dim(part):
                    visited = np.bincount(probes(unit, hashes, distance, target, most + 1)[0][0], minlength=len(rows))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[visited > most]))], ["key"])

    return run


def fit(entries: DataFrame, k: int) -> DataFrame:
    """(dim, hashes, distance) of each vector length with more than BLOCK_ROWS entries: all lengths in one grouped pass.

    The distance is that of k-th neighbours (of 9 in 10 rows): FIT_QUERIES entries of a
    length, first by key, meet all its entries, in blocks. The number of hashes has the
    least work on FIT_ROWS entries. Rarer lengths need no fit: they are searched whole.
    """
    sizes = entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS).select("dim", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts"))
    sizes = stored(sizes, "ann-lengths")
    frequent = entries.join(sizes, "dim")
    first = Window.partitionBy("dim").orderBy("key")
    sample = stored(frequent.withColumn("place", F.row_number().over(first)).where(F.col("place") <= FIT_ROWS).select("dim", "parts", "place", "vec"), "ann-sample")

    def near(asked, rows):
        if not asked.num_rows or not rows.num_rows:
            return pa.table({"dim": pa.array([], pa.int32()), "q": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        # ids counted with their entry, but not the asked vector itself
        sims = _unit(_vectors(asked["vec"].to_pylist())) @ _unit(_vectors(rows["vec"].to_pylist())).T
        sims[sims > 1 - 1e-12] = -2.0
        best = -np.partition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, :k]
        q = np.repeat(asked["place"].to_numpy(), best.shape[1]).astype(np.int64)
        return pa.table({"dim": pa.array(np.full(len(q), asked["dim"][0].as_py()), pa.int32()), "q": pa.array(q), "sim": pa.array(best.ravel())})

    asked = sample.where(F.col("place") <= FIT_QUERIES).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("dim", "part", "place", "vec")
    dealt = frequent.select("dim", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "vec")
    found = asked.groupBy("dim", "part").cogroup(dealt.groupBy("dim", "part")).applyInArrow(near, "dim int, q long, sim double").where("sim > -2")
    place = Window.partitionBy("dim", "q").orderBy(F.col("sim").desc())
    kth = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).groupBy("dim", "q").agg(F.min("sim").alias("sim"))
    reach = kth.groupBy("dim").agg(F.percentile("sim", F.lit(0.1)).alias("sim"))  # FIT_QUERIES values a length
    distance = F.coalesce(F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0))), F.lit(1.4))
    known = sample.join(reach, "dim", "left").select("dim", distance.alias("distance"), "place", "vec")

    def choose(key, rows):
        rows = rows.sort_by("place")
        d = rows["distance"][0].as_py()
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "hashes": pa.array([_fewest_visits(_unit(_vectors(rows["vec"].to_pylist())), d)], pa.int32()), "distance": pa.array([d])})

    plan = stored(known.groupBy("dim").applyInArrow(choose, "dim int, hashes int, distance double"), "ann-plan")
    discard(sizes, sample)
    return plan


def _fewest_visits(sample: np.ndarray, distance: float) -> int:
    """The number of hashes with the least estimated work: rows visited, and buckets probed as if each cost a few rows."""
    asked, best = sample[:32], (math.inf, HASHES[0])
    for hashes in HASHES:
        visits = probes(asked, hashes, distance, TARGET, MOST_PROBES + 1)
        if max(np.bincount(visits[0][0])) > MOST_PROBES:
            break  # the target is out of reach in that many buckets
        share = 0.0
        for table, (_, code) in enumerate(visits):
            a, b = _planes(sample.shape[1], table, hashes)
            codes, n = np.unique(_code(np.floor((sample @ a + b) / WIDTH).astype(np.int64)), return_counts=True)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            share += n[at][codes[at] == code].sum() / len(sample)
        best = min(best, (share / len(asked) + 1e-4 * len(visits[0][0]) / len(asked), hashes))
    return best[1]


def _first(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _best(found: np.ndarray, score: np.ndarray, at_q: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best ids of each visitor, each id by its best row; ties by id."""
    order = np.lexsort((-score, found, at_q))
    order = order[_first(at_q[order], found[order])]
    order = order[np.lexsort((found[order], -score[order], at_q[order]))]
    at_q = at_q[order]
    return order[np.arange(len(at_q)) - np.searchsorted(at_q, at_q) < k]


def _nearest(q: np.ndarray, m: np.ndarray, held: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(visitor, id, score): the k best ids among members m, which hold these ids, for each visitor, each by the best of its vectors."""
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    ids, of = np.fromiter((i for x in held for i in x), np.int64, int(sizes.sum())), np.repeat(np.arange(len(held)), sizes)
    order = np.argsort(ids, kind="stable")
    ids, of = ids[order], of[order]
    starts = np.flatnonzero(_first(ids))
    rows = np.diff(np.append(starts, len(ids)))
    last = max(0, len(starts) - k)
    out_q, out_m = [], []
    for at in range(0, len(q), 512):
        sims = (q[at : at + 512] @ m.T)[:, of]
        best = np.maximum.reduceat(sims, starts, axis=1)  # of each id
        floor = np.partition(best, last, axis=1)[:, last]
        least = np.maximum(np.repeat(best, rows, axis=1), floor[:, None])
        hit = np.nonzero(sims >= least - _SLACK)
        out_q.append(hit[0] + at)
        out_m.append(hit[1])
    at_q, at_m = np.concatenate(out_q), np.concatenate(out_m)
    score, found = (q[at_q] * m[of[at_m]]).sum(1), ids[at_m]
    take = _best(found, score, at_q, k)
    return at_q[take], found[take], score[take]


def _rank(k: int):
    """The k best ids of a block for each visiting vector; where rows have buckets, only those of one bucket meet."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        none = pa.table({"key": pa.array([], pa.binary()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not members.num_rows:
            return none
        places: dict = {}
        who = np.array([places.setdefault(x, len(places)) for x in queries["key"].to_pylist()])
        q, m, held = _unit(_vectors(queries["vec"].to_pylist())), _unit(_vectors(members["vec"].to_pylist())), members["ids"].to_pylist()
        if "bucket" in queries.column_names:
            of_q, of_m = queries["bucket"].to_numpy(), members["bucket"].to_numpy()
            by_q, by_m = np.argsort(of_q, kind="stable"), np.argsort(of_m, kind="stable")
            both = np.intersect1d(of_q, of_m)
            spans = [[np.searchsorted(x, both, side) for side in ("left", "right")] for x in (of_q[by_q], of_m[by_m])]
            meetings = [(by_q[a:b], by_m[c:d]) for a, b, c, d in zip(*spans[0], *spans[1], strict=True)]
        else:
            meetings = [(np.arange(len(q)), np.arange(len(m)))]
        out = []
        for rows_q, rows_m in meetings:
            at_q, found, score = _nearest(q[rows_q], m[rows_m], [held[i] for i in rows_m], k)
            out.append((who[rows_q[at_q]], found, score))
        if not out:
            return none
        at_q, found, score = (np.concatenate([x[i] for x in out]) for i in range(3))
        take = _best(found, score, at_q, k)
        keys = list(places)
        return pa.table({"key": pa.array([keys[i] for i in at_q[take]], pa.binary()), "vec_id": found[take], "score": score[take]})

    return run


def _in_blocks(visits: DataFrame, members: DataFrame, keys: list[str], k: int, written: list[DataFrame]) -> DataFrame:
    """(key, vec_id, score, rank): each visiting vector against all members with its keys (and its bucket, if there is one); large groups are cut into blocks on both sides."""

    def parts(side: DataFrame, name: str) -> DataFrame:
        many = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS)
        return stored(many.select(*keys, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias(name)), "ann-large")

    m_parts, v_parts = parts(members, "mp"), parts(visits, "vp")
    written += [m_parts, v_parts]
    every = lambda name: F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1)
    own = lambda name: F.pmod(F.xxhash64("key"), F.coalesce(name, F.lit(1)).cast("long")).cast("int")

    def dealt(side: DataFrame, m, v) -> DataFrame:
        return side.join(m_parts, keys, "left").join(v_parts, keys, "left").withColumn("m", m).withColumn("v", v).drop("mp", "vp")

    members = dealt(members, own("mp"), F.explode(every("vp")))
    visits = dealt(visits, F.explode(every("mp")), own("vp"))
    found = visits.groupBy(*keys, "m", "v").cogroup(members.groupBy(*keys, "m", "v")).applyInArrow(_rank(k), "key binary, vec_id long, score double")
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    merged = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """The k nearest found, by cosine, of every row whose id is divisible by ``every``.

    Returns query_id, rank, vec_id, score. Rows with a null id or a vector that is null,
    empty, zero or has null or non-finite parts take no part; only vectors of one
    length are compared, whatever that is. Rows of one id are one candidate, scored by
    the best of them, and never their own query's; equal scores rank by id. Equal
    vectors are hashed once, with their k + 1 smallest ids, which no query can exhaust.
    A query that finds fewer than k, or whose buckets end before the target is reached,
    goes on to further ones, at last to all that are occupied if it still lacks some.
    Lengths of up to BLOCK_ROWS vectors are searched whole. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    )

    def pack(batches):
        import hashlib

        for batch in batches:
            packed = [(np.asarray(v.values, np.float64) + 0.0).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // 8 for p in packed], pa.int32()), pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in packed], pa.binary()), pa.array(packed, pa.binary())], ["id", "dim", "key", "vec"])

    asked_for = F.pmod("id", F.lit(every)) == 0
    # the rank limit works before the shuffle too, so of equal vectors few rows travel
    packed = rows.mapInArrow(pack, "id long, dim int, key binary, vec binary").dropDuplicates(["key", "id"])
    few = Window.partitionBy("key").orderBy("id")
    entries = packed.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 1)
    entries = stored(entries.groupBy("key").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.array_sort(F.collect_set("id")).alias("ids")), "ann-entries")
    askers = stored(rows.where(asked_for).mapInArrow(pack, "id long, dim int, key binary, vec binary").select(F.col("id").alias("query_id"), "key").distinct(), "ann-askers")
    plan = fit(entries, k)
    planned = entries.join(plan, "dim").select("key", "vec", "ids", "hashes", "distance")
    members = stored(planned.mapInArrow(_indexed, _BUCKETS), "ann-index")
    asking = entries.join(askers.select("key").distinct(), "key", "left_semi")
    # lengths without a fit are searched whole
    rare = stored(asking.join(plan.select("dim"), "dim", "left_anti"), "ann-rare")
    everyone = entries.join(plan.select("dim"), "dim", "left_anti").select("dim", "key", "vec", "ids")
    written = [rare]
    found = stored(_in_blocks(rare.select("dim", "key", "vec", "ids"), everyone, ["dim"], k + 1, written), "ann-found")
    wanted = asking.join(plan, "dim").select("key", "vec", "ids", "hashes", "distance", "dim")
    written.append(found)
    cell = F.pmod(F.xxhash64("bucket"), F.lit(max(1, -(-members.count() // (TABLES * BLOCK_ROWS // 2)))))
    for chance, most in ((target, MOST_PROBES), (1 - 1e-6, 4 * MOST_PROBES), (1.0, None)):
        if most:
            visits = wanted.select("key", "vec", "ids", "hashes", "distance").mapInArrow(_visiting(chance, most), _BUCKETS)
            # a block takes many buckets of a table, so a visitor brings k + 1 rows from it, not from each of its buckets
            now = _in_blocks(visits.withColumn("cell", cell), members.withColumn("cell", cell), ["dim", "table", "cell"], k + 1, written)
        else:  # all occupied buckets of a table: few queries come so far
            home = members.where("table = 0")
            now = _in_blocks(wanted.select("dim", "key", "vec", "ids"), home.select("dim", "key", "vec", "ids"), ["dim"], k + 1, written)
        now = stored(now, "ann-found")
        written.append(now)
        if most is None:
            found = found.unionByName(now)
            break
        enough = now.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("key")
        # those whose visits ended under the target go on too
        unsure = wanted.select("key", "vec", "ids", "hashes", "distance").mapInArrow(_unsure(target, most), "key binary")
        enough = stored(enough.join(unsure.distinct(), "key", "left_anti"), "ann-enough")
        written.append(enough)
        short = stored(wanted.join(enough, "key", "left_anti"), "ann-short")
        written.append(short)
        found = found.unionByName(now)  # what was found stays, further buckets add to it
        if not short.limit(1).count():
            break
        wanted = short
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    mine = askers.join(found, "key").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = mine.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = stored(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "ann-result")
    discard(entries, askers, plan, members, *written)
    return out
