"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A segmentation is a path over pieces. A chunk of a giant document does not know how
the piece that crosses its left edge lies, so it works out, for every state there and
every state at its right edge, the best path between (a transfer matrix over the
max-plus semiring). The matrices are combined associatively, which fixes the state at
every edge, and each chunk then traces its own path back.

For unigram models a path's weight is the sum of its piece scores. For BPE models the
encoding is the one path in which every two neighbours are the encoding of their
joined text, so allowed steps weigh 0 and others minus infinity. Either way a piece
never reaches across the start of a word (checked on the vocabulary), so all paths
meet there and the matrix of a chunk with such a cut is an outer sum.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import default_partitions, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 8192
GIANT_CHARS = 2 * CHUNK_CHARS
SPACE = "▁"
_MEMO = 200_000
_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
CUT = (0, 0)  # the state of an edge that no piece crosses and where all paths meet


class Pieces:
    """A model's vocabulary, with the library for units of a few characters."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        model = pb.ModelProto()
        model.ParseFromString(proto)
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models that keep text as it is, with a space before it, are supported")
        self.bpe = model.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.bytes = model.trainer_spec.byte_fallback
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.score = {p.piece: p.score for p in model.pieces if p.type in (1, 4)}
        self.low = min(self.score.values()) - 10.0
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece reaches across the start of a word")
        self.longest = max(map(len, self.ids))
        self.memo: dict[str, bytes] = {}
        self.step = lru_cache(1 << 14)(self._step)

    def unit(self, text: str) -> list[int]:
        """Ids of a text that starts at a cut, given with SPACE for blanks."""
        if text == SPACE and SPACE in self.ids:
            return [self.ids[SPACE]]
        if text[0] == SPACE:
            return self.lib.encode(text[1:], num_threads=1)
        return self.lib.encode("\n" + text, num_threads=1)[len(self.lib.encode("\n", num_threads=1)) :]

    def encode_units(self, units: list[str]) -> bytes:
        """Ids (4 bytes each) of whole units one after another; each distinct unit is encoded once."""
        memo = self.memo
        new = [u for u in dict.fromkeys(units) if u not in memo]
        if len(memo) + len(new) > _MEMO:
            memo.clear()
            new = list(dict.fromkeys(units))
        spaced = [u for u in new if u[0] == SPACE and len(u) > 1]
        for u, ids in zip(spaced, self.lib.encode([u[1:] for u in spaced], num_threads=1) if spaced else [], strict=True):
            memo[u] = np.array(ids, np.int32).tobytes()
        for u in new:
            if u not in memo:
                memo[u] = np.array(self.unit(u), np.int32).tobytes()
        return b"".join([memo[u] for u in units])

    def encode(self, text: str | None) -> bytes:
        return self.encode_units(units_of(text)) if text else b""

    def ids_of(self, piece: str) -> list[int]:
        """A lattice edge's ids: a piece, or one unknown character as its bytes or the unknown id."""
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.lib.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()] if self.bytes else [self.lib.unk_id()]

    def _step(self, a: str | None, b: str) -> float:
        """Weight of the step from piece a (None: a cut) to piece b."""
        if not self.bpe:
            return self.score.get(b, self.low)
        return 0.0 if self.unit((a or "") + b) == (self.ids_of(a) if a else []) + self.ids_of(b) else -np.inf

    def edges(self, text: str, i: int):
        """Ends of the pieces of the lattice that start at i."""
        found = [j for j in range(i + 1, min(len(text), i + self.longest) + 1) if text[i:j] in self.ids]
        return found if found and found[0] == i + 1 else [i + 1, *found]


def units_of(text: str) -> list[str]:
    return _UNIT.findall(SPACE + text.replace(" ", SPACE))


def is_cut(text: str, i: int) -> bool:
    """No piece reaches from before i to behind it."""
    return 0 < i < len(text) and ((text[i] == SPACE and text[i - 1] != SPACE) or text[i] == "\n" or text[i - 1] == "\n")


def edge_states(model: Pieces, text: str, i: int) -> list[tuple[int, int]]:
    """Pieces (begin, end) with begin < i <= end: those that may cover or close at the edge i; or the cut."""
    if i in (0, len(text)) or is_cut(text, i):
        return [CUT]
    return [(a, b) for a in range(max(0, i - model.longest), i) for b in model.edges(text, a) if b >= i and not any(is_cut(text, c) for c in range(a + 1, b))]


def _walk(model: Pieces, text: str, entry: list[tuple[tuple[int, int], np.ndarray]], begin: int, stop: int):
    """Best weights of the pieces that start in [begin, stop), for every entry state; entry: (piece or cut, weights)."""
    ending: dict[int, list] = {}
    for (a, b), weights in entry:
        ending.setdefault(begin if (a, b) == CUT else b, []).append(((a, b), weights))
    done = dict(entry)
    for i in range(begin, stop):
        here = ending.get(i)
        if not here:
            continue
        for j in model.edges(text, i):
            if any(is_cut(text, c) for c in range(i + 1, j)):
                continue
            best = None
            for (a, b), weights in here:
                step = model.step(None if (a, b) == CUT or is_cut(text, i) else text[a:b], text[i:j])
                if step > -np.inf:
                    best = weights + step if best is None else np.maximum(best, weights + step)
            if best is not None:
                done[i, j] = best
                ending.setdefault(j, []).append(((i, j), best))
    return done, ending


def cuts_in(text: str, lo: int, hi: int) -> tuple[int | None, int | None]:
    found = [i for i in range(lo, hi + 1) if is_cut(text, i)]
    return (found[0], found[-1]) if found else (None, None)


def _part(model: Pieces, text: str, lo: int, hi: int, left: list, right: list) -> np.ndarray:
    """Matrix left x right over a stretch that is walked whole."""
    eye = np.where(np.eye(len(left), dtype=bool), 0.0, -np.inf)
    done, ending = _walk(model, text, [(s, eye[i]) for i, s in enumerate(left)], lo, hi)
    out = np.full((len(left), len(right)), -np.inf)
    for j, state in enumerate(right):
        if state == CUT:
            for piece, weights in ending.get(hi, []):
                out[:, j] = np.maximum(out[:, j], weights)
            if lo == hi:
                out[:, j] = 0.0
        elif state in done:
            out[:, j] = done[state]
    return out


def transfer(model: Pieces, text: str, lo: int, hi: int) -> tuple[list, list, np.ndarray]:
    """States at lo, states at hi, and the best weight between each two. The stretch between the first and last cut adds the same to all and is left out."""
    left, right = edge_states(model, text, lo), edge_states(model, text, hi)
    first, last = (lo, hi) if left == [CUT] and right == [CUT] else cuts_in(text, lo, hi)
    if first is None:
        return left, right, _part(model, text, lo, hi, left, right)
    head = np.zeros((len(left), 1)) if left == [CUT] else _part(model, text, lo, first, left, [CUT])
    tail = np.zeros((1, len(right))) if right == [CUT] else _part(model, text, last, hi, [CUT], right)
    return left, right, head + tail


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def prefix_products(mats: list[np.ndarray]) -> list[np.ndarray]:
    """All prefixes' products by recursive doubling."""
    out, width = list(mats), 1
    while width < len(out):
        out = [combine(out[i - width], m) if i >= width else m for i, m in enumerate(out)]
        width *= 2
    return out


def settle(chunks: list[tuple[list, list, np.ndarray]]) -> list[tuple[int, int]]:
    """The state at every edge, first to last, from the chunks' matrices."""
    mats = [m for _, _, m in chunks]
    behind = [m.T for m in prefix_products([m.T for m in reversed(mats)])][::-1]
    states, at = [chunks[0][0][0]], 0
    for i, m in enumerate(mats):  # one path, also where several weigh the same
        at = int(np.argmax(m[at] + (behind[i + 1].max(1) if i + 1 < len(mats) else 0.0)))
        states.append(chunks[i][1][at])
    return states


def _trace(model: Pieces, text: str, lo: int, hi: int, enter: tuple[int, int], leave: tuple[int, int]) -> list[int]:
    """Ids of the pieces that start in [lo, hi) on the best path from enter to leave."""
    back: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {enter: (0.0, None)}
    ending = {lo if enter == CUT else enter[1]: [enter]}
    for i in range(lo, hi):
        for j in model.edges(text, i) if i in ending else ():
            if any(is_cut(text, c) for c in range(i + 1, j)):
                continue
            for p in ending[i]:
                w = back[p][0] + model.step(None if p == CUT or is_cut(text, i) else text[p[0] : p[1]], text[i:j])
                if w > back.get((i, j), (-np.inf, None))[0]:
                    if (i, j) not in back:
                        ending.setdefault(j, []).append((i, j))
                    back[i, j] = (w, p)
    at = leave if leave != CUT else max(ending.get(hi, [CUT]), key=lambda p: back[p][0])
    path = []
    while at is not None and at != enter:
        path.append(at)
        at = back[at][1]
    return [x for a, b in reversed(path) for x in model.ids_of(text[a:b])]


def backtrace(model: Pieces, text: str, lo: int, hi: int, enter: tuple[int, int], leave: tuple[int, int]) -> bytes:
    """One chunk's ids (4 bytes each), given the states at its edges."""
    first, last = (lo, hi) if enter == CUT and leave == CUT else cuts_in(text, lo, hi)
    if first is None:
        return np.array(_trace(model, text, lo, hi, enter, leave), np.int32).tobytes()
    head = [] if enter == CUT else _trace(model, text, lo, first, enter, CUT)
    tail = [] if leave == CUT else _trace(model, text, last, hi, CUT, leave)
    begin, stop = (lo if enter == CUT else first), (hi if leave == CUT else last)
    middle = model.encode_units(_UNIT.findall(text[begin:stop])) if stop > begin else b""
    return np.array(head, np.int32).tobytes() + middle + np.array(tail, np.int32).tobytes()


def scan_encode(model: Pieces, text: str, chunk_chars: int = CHUNK_CHARS) -> list[int]:
    """Encode one text by the scan, all steps in place; what encode_documents does over tasks."""
    if not text:
        return []
    whole = SPACE + text.replace(" ", SPACE)
    edges = [*range(0, len(whole), chunk_chars), len(whole)]
    states = settle([transfer(model, whole, a, b) for a, b in zip(edges, edges[1:], strict=False)])
    return np.frombuffer(b"".join(backtrace(model, whole, a, b, s, t) for a, b, s, t in zip(edges, edges[1:], states, states[1:], strict=False)), np.int32).tolist()


def decode(model: Pieces, ids: list[int]) -> str:
    return model.lib.decode(ids)


_loaded: dict[int, Pieces] = {}


def _model(proto: bytes) -> Pieces:
    key = hash(proto)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(proto)
    return _loaded[key]


def _ids_array(packed: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(packed), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)), pa.array(flat))


def encode_documents(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, chunk_chars: int = CHUNK_CHARS, giant_chars: int = GIANT_CHARS, check: bool = False) -> DataFrame:
    """docs with piece_ids (array<int>) and n_chunks added; with check also decoded_equal: whether decoding gives the text back.

    Texts up to giant_chars are encoded where they lie. Longer ones are cut into
    chunks that are worked on by any task: matrices first, then one small scan for
    each distinct text, then the chunks' own paths, put together by text. Equal giants
    are one job, known by the SHA-256 of the text; a task passes on a text once. A null
    or empty text has no pieces. Repeated rows each get a row; there are no ties to
    break. An empty table gives an empty result. Columns of docs named piece_ids,
    n_chunks or, with check, decoded_equal are replaced; other columns may have any
    name.
    """
    with open(model_path, "rb") as f:
        proto = f.read()  # half a megabyte, sent along with the code
    pad = 2 * Pieces(proto).longest  # on both sides of a chunk: more than the pieces that may reach across its edges
    added = ["piece_ids", "n_chunks", *(["decoded_equal"] if check else [])]
    docs = docs.drop(*added)
    types = dict(docs.dtypes)
    # inside, columns have names of their own, so none of the input's can clash
    own = [f"c{i}" for i in range(len(docs.columns))]
    back = [F.col(c).alias(name) for c, name in zip(own, docs.columns, strict=True)]
    rows = docs.toDF(*own)
    text = own[docs.columns.index(text_col)]
    giant = F.coalesce(F.length(text) > giant_chars, F.lit(False))
    key = F.sha2(text, 256)
    results = "piece_ids array<int>, n_chunks int" + (", decoded_equal boolean" if check else "")
    schema = ", ".join([*(f"{c} {types[name]}" for c, name in zip(own, docs.columns, strict=True)), results])

    def decoded(lib, texts, packed):
        return [pa.array([lib.decode(np.frombuffer(p, np.int32).tolist()) == (t or "") for t, p in zip(texts, packed, strict=True)], pa.bool_())] if check else []

    def small(batches):
        model = _model(proto)
        for batch in batches:
            texts = batch.column(own.index(text)).to_pylist()
            packed = [model.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, _ids_array(packed), pa.array(np.ones(len(texts), np.int32)), *decoded(model.lib, texts, packed)], [*own, *added])

    def cut(batches):
        seen: set = set()  # keys of this task's giants
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k in seen:
                    continue
                seen.add(k)
                whole = SPACE + t.replace(" ", SPACE)
                los = list(range(0, len(whole), chunk_chars))
                for at in range(0, len(los), 256):
                    lo = los[at : at + 256]
                    begins = [max(0, x - pad) for x in lo]
                    his = [min(x + chunk_chars, len(whole)) for x in lo]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(lo)), *(pa.array(x, pa.int32()) for x in (lo, his, begins)), pa.array([whole[b : h + pad] for b, h in zip(begins, his, strict=True)])], ["job", "lo", "hi", "origin", "part"])

    def matrices(batches):
        model, seen = _model(proto), set()
        for batch in batches:
            jobs, los = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            fresh = []
            for i, one in enumerate(zip(jobs, los, strict=True)):
                if one not in seen:  # copies from other tasks
                    seen.add(one)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            rows, out = batch.to_pydict(), []
            for lo, hi, origin, part in zip(rows["lo"], rows["hi"], rows["origin"], rows["part"], strict=True):
                left, right, m = transfer(model, part, lo - origin, hi - origin)
                shift = lambda s, o=origin: [-1, -1] if s == CUT else [s[0] + o, s[1] + o]
                out.append(([x for s in left for x in shift(s)], [x for s in right for x in shift(s)], m.ravel().tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.list_(pa.float64()))], [*batch.schema.names, "entry", "exit", "weights"])

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        rows = table.to_pydict()

        def states(flat):
            return [CUT if flat[i] < 0 else (flat[i], flat[i + 1]) for i in range(0, len(flat), 2)]

        chunks = [(states(a), states(b), np.array(w).reshape(len(a) // 2, len(b) // 2)) for a, b, w in zip(rows["entry"], rows["exit"], rows["weights"], strict=True)]
        at = [list(s) if s != CUT else [-1, -1] for s in settle(chunks)]
        return pa.table({"job": table["job"], "lo": table["lo"], "enter": pa.array(at[:-1], pa.list_(pa.int32())), "leave": pa.array(at[1:], pa.list_(pa.int32()))})

    def paths(batches):
        model = _model(proto)
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for lo, hi, origin, part, enter, leave in zip(rows["lo"], rows["hi"], rows["origin"], rows["part"], rows["enter"], rows["leave"], strict=True):
                state = [CUT if s[0] < 0 else (s[0] - origin, s[1] - origin) for s in (enter, leave)]
                out.append(backtrace(model, part, lo - origin, hi - origin, *state))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["job", "lo", "ids"])

    def finish(batches):
        lib = _model(proto).lib
        for batch in batches:
            packed = [b"".join(parts) for parts in batch.column(len(own)).to_pylist()]
            counts = pa.array([len(parts) for parts in batch.column(len(own)).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], _ids_array(packed), counts, *decoded(lib, batch.column(own.index(text)).to_pylist(), packed)], [*own, *added])

    encoded = rows.where(~giant).mapInArrow(small, schema)
    giants = rows.where(giant).withColumn("job", key)
    tasks = default_partitions(docs.sparkSession)
    chunked = giants.select("job", text).mapInArrow(cut, "job string, lo int, hi int, origin int, part string").repartition(tasks, "job", "lo")
    chunked = stored(chunked.mapInArrow(matrices, "job string, lo int, hi int, origin int, part string, entry array<int>, exit array<int>, weights array<double>"), "piece-chunks")
    settled = chunked.select("job", "lo", "entry", "exit", "weights").groupBy("job").applyInArrow(scan, "job string, lo int, enter array<int>, leave array<int>")
    traced = stored(chunked.select("job", "lo", "hi", "origin", "part").join(settled, ["job", "lo"]).mapInArrow(paths, "job string, lo int, ids binary"), "piece-paths")
    joined = traced.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("lo", "ids"))).alias("parts")).select("job", F.transform("parts", lambda p: p["ids"]).alias("parts"))
    found = giants.join(joined, "job").select(*own, "parts").mapInArrow(finish, schema)
    return encoded.unionByName(found).select(*back, *added)
