"""Conversation repair by error-correcting Earley parsing over a weighted role grammar.

The grammar of roles is right-linear: an optional system turn, then pairs of user and
assistant. The productions of errors stand beside it: a turn may be deleted or its
role be changed, and a missing turn may be inserted. Parsing goes turn by turn; an
item of the chart is a predicted symbol with the least (cost, audit) of all that was
read, where the audit is one letter an edit. Since what follows a turn is always the
end of its production, completed parts have one caller and items need no origin.

A conversation of usual length is parsed in one piece. A long one is sorted over many
tasks and cut into segments; a segment is parsed from each symbol that may be open at
its start, which gives a table (symbol before, symbol after) -> (cost, audit). The
tables are put together in order, which fixes the symbols at every cut, and each
segment then writes its own part of the repair. Least audits of equal cost never
extend one another, so the least of a whole is made of the least of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import BLANKS, default_partitions, discard, stored

#: symbol -> productions (role initial, next symbol); None ends the conversation.
GRAMMAR: dict[str, list[tuple[str, str] | None]] = {
    "start": [None, ("s", "first"), ("u", "reply")],
    "first": [("u", "reply")],
    "reply": [("a", "more")],
    "more": [None, ("u", "reply")],
}
#: Roles that may be inserted or given anew.
ROLES = {"u": "user", "a": "assistant"}
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Longer conversations are cut into segments.
LONG_ROWS, LONG_CHARS, SEGMENT_ROWS, SEGMENT_CHARS = 2000, 4 << 20, 512, 1 << 20

Column_ = dict[str, tuple[int, str]]


def _better(column: Column_, symbol: str, item: tuple[int, str]) -> bool:
    if symbol in column and column[symbol] <= item:
        return False
    column[symbol] = item
    return True


def _insert(column: Column_) -> Column_:
    """The column with all items that inserted turns lead to."""
    todo = list(column)
    while todo:
        at = todo.pop()
        cost, audit = column[at]
        for production in GRAMMAR[at]:
            if production and production[0] in ROLES and _better(column, production[1], (cost + INSERT, audit + "I")):
                todo.append(production[1])
    return column


def _scan(column: Column_, initial: str, truncated: bool) -> Column_:
    """The next column after a turn that may stay."""
    after: Column_ = {}
    extra = TRUNCATED if truncated else 0
    for at, (cost, audit) in column.items():
        _better(after, at, (cost + DELETE, audit + "D"))
        for production in GRAMMAR[at]:
            if production and production[0] == initial:
                _better(after, production[1], (cost + extra, audit + "K"))
            elif production and production[0] in ROLES:
                _better(after, production[1], (cost + RETYPE + extra, audit + "R"))
    return _insert(after)


def _parse(turns: tuple[tuple[str, str, int], ...], start: str) -> Column_:
    """The last column of the chart; a turn is (role initial, fault, copies), faults being D (must go), T (truncated) or none."""
    column = _insert({start: (0, "")})
    for initial, fault, copies in turns:
        column = {at: (cost + DELETE * copies, audit + "D" * copies) for at, (cost, audit) in column.items()} if fault == "D" else _scan(column, initial, fault == "T")
        if fault == "D":
            column = _insert(column)
    return column


@lru_cache(maxsize=1 << 16)
def parse(turns: tuple[tuple[str, str, int], ...]) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    column = _parse(turns, "start")
    return min(column[at] for at, productions in GRAMMAR.items() if None in productions and at in column)


def repair(audit: str, turns: list[tuple[str, str, int]], kept: list[tuple[str, str]], at: str = "start") -> Iterator[str]:
    """Lines ``role:text`` that an audit leaves, from a symbol on; kept has role and text of the turns that may stay."""
    rows, texts = iter(t for turn in turns for t in [turn] * turn[2]), iter(kept)
    for edit in audit:
        turn = next(rows) if edit != "I" else None
        role, text = next(texts) if turn and turn[1] != "D" else ("", "")
        if edit == "D":
            continue
        wanted = turn[0] if edit == "K" else None
        initial, at = next(p for p in GRAMMAR[at] if p and (p[0] == wanted if wanted else p[0] in ROLES))
        yield f"{role if edit == 'K' else ROLES[initial]}:{text}"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with planted faults by the crc32 of ``conv_id:turn``; nulls of role and text are one space, dropped rows have no copies and no text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("dm_code") == 1, F.lit("")).when(F.col("dm_code") == 2, F.translate(name("text"), ".!?", "")).when(F.col("dm_code") != 0, name("text"))
    return rows.withColumn("dm_code", code).select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("dm_code") == 4, F.lit("user")).otherwise(name("role")).alias("role"), text.alias("text"), F.when(F.col("dm_code") == 0, 0).when(F.col("dm_code") == 3, 2).otherwise(1).alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """With the fault that a row has by itself: D blank, T truncated, else empty."""
    end = F.rtrim("text", F.lit(BLANKS))
    return rows.withColumn("fault", F.when(end == "", "D").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "T").otherwise(""))


_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


def _whole(batches):
    """Conversations that lie together in order: one row each."""
    id_type, state, out = None, None, []

    def close(s):
        turns, kept, seen, numbers, known, _ = s[1:]
        cost, audit = parse(tuple(turns)) if turns else (0, "")
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        sha = hashlib.sha256("\n".join(repair(audit, turns, kept)).encode()).hexdigest()
        out.append((s[0], gaps, *numbers, cost, audit, sha))

    def flush():
        columns = list(zip(*out, strict=True))
        kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", *_NUMBERS, "audit", "repaired_sha256"])
        out.clear()
        return batch

    for batch in batches:
        id_type = batch.schema.field(0).type
        for conv, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    close(state)
                #: id, turns, rows that may stay, (role, text) seen, blank/duplicate/truncated/illegal, turn numbers, last initial
                state = [conv, [], [], set(), [0, 0, 0, 0], set(), None]
            _, turns, kept, seen, numbers, known, before = state
            for _ in range(copies):
                initial = role[:1]
                if before is not None and before + initial not in _LEGAL:
                    numbers[3] += 1
                before = state[6] = initial
                if turn is not None:
                    known.add(turn)
                if fault == "D":
                    numbers[0] += 1
                elif (role, text) in seen:
                    numbers[1] += 1
                else:
                    seen.add((role, text))
                    kept.append((role, text))
                    numbers[2] += fault == "T"
                    turns.append((initial, fault, 1))
                    continue
                turns.append(("", "D", 1))
        if len(out) >= 1000:
            yield flush()
    if state is not None:
        close(state)
    if out:
        yield flush()


def _order(rows: DataFrame) -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _typed(df: DataFrame, fields: str) -> str:
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {fields}"


_SEGMENT = "seq long, initials string, faults string, copies array<int>, roles array<string>, texts array<string>, head string, tail string, blank long, duplicate long, truncated long, illegal long, paths array<struct<before:string,after:string,cost:long,audit:string>>"


def _segments(segment_rows: int, segment_chars: int):
    """Sorted rows (conv_id, role, text, copies, fault, first) cut into segments, each with its table of paths."""

    def run(batches):
        from pyspark import TaskContext

        seq, last, part, out = TaskContext.get().partitionId() << 32, None, None, []

        def close():
            turns = part["turns"]
            paths = [{"before": a, "after": b, "cost": c, "audit": x} for a in GRAMMAR for b, (c, x) in _parse(tuple(turns), a).items()]
            n = part["numbers"]
            out.append((last[0], seq, "".join(t[0] or " " for t in turns), "".join(t[1] or "-" for t in turns), [t[2] for t in turns], [k[0] for k in part["kept"]], [k[1] for k in part["kept"]], part["head"], part["tail"], *n, paths))

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))]
            names = ["conv_id", "seq", "initials", "faults", "copies", "roles", "texts", "head", "tail", "blank", "duplicate", "truncated", "illegal", "paths"]
            for conv, role, text, copies, fault, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None or last[0] != conv or len(part["turns"]) >= segment_rows or part["chars"] >= segment_chars:
                    if part is not None:
                        close()
                        seq += 1
                    part, last = {"turns": [], "kept": [], "numbers": [0, 0, 0, 0], "chars": 0, "head": role[:1], "tail": None}, (conv,)
                initial, n = role[:1], part["numbers"]
                if part["tail"] is not None and part["tail"] + initial not in _LEGAL:
                    n[3] += 1
                if initial + initial not in _LEGAL:
                    n[3] += copies - 1
                part["tail"] = initial
                stays = fault != "D" and first
                if fault == "D":
                    n[0] += copies
                else:
                    n[1] += copies - stays
                    n[2] += stays and fault == "T"
                if stays:
                    part["turns"].append((initial, fault, 1))
                    part["kept"].append((role, text))
                    part["chars"] += len(text)
                if copies > stays:
                    part["turns"].append(("", "D", copies - stays))
            if len(out) >= 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out.clear()
        if part is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _since_fork(one: tuple, other: tuple) -> tuple[str, str]:
    """The audits of two paths of one length from where they part."""
    left, right = [], []
    while one is not other:
        left.append(one[1])
        right.append(other[1])
        one, other = one[0], other[0]
    return "".join(reversed(left)), "".join(reversed(right))


def _less(one: tuple, other: tuple) -> bool:
    left, right = _since_fork(one, other)
    return left < right


def _compose(table: pa.Table) -> pa.Table:
    """The symbols and audits of a conversation's segments on its least path; only audits and numbers are in the group, no texts.

    A path is a chain of (path before, audit, symbol before), so paths share what they have in common.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
    column: dict[str, tuple[int, tuple]] = {"start": (0, ())}
    for r in rows:
        now: dict[str, tuple[int, tuple]] = {}
        for p in r["paths"]:
            if p["before"] in column:
                cost, path = column[p["before"]]
                cost, path, had = cost + p["cost"], (path, p["audit"], p["before"]), now.get(p["after"])
                if had is None or cost < had[0] or (cost == had[0] and _less(path, had[1])):
                    now[p["after"]] = (cost, path)
        column = now
    best = None
    for at, (cost, path) in column.items():
        if None in GRAMMAR[at] and (best is None or cost < best[0] or (cost == best[0] and _less(path, best[1]))):
            best = (cost, path)
    cost, path = best
    out = []
    while path:
        out.append((path[2], path[1]))
        path = path[0]
    out.reverse()
    audit, tail = "".join(x for _, x in out), None
    illegal = 0
    for r in rows:
        illegal += r["illegal"] + (tail is not None and tail + r["head"] not in _LEGAL)
        tail = r["tail"]
    total = {n: sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated")} | {"illegal": illegal, "cost": cost}
    first = [True] + [False] * (len(rows) - 1)
    return pa.table({
        "conv_id": table["conv_id"].combine_chunks(), "seq": pa.array([r["seq"] for r in rows], pa.int64()), "before": pa.array([a for a, _ in out], pa.string()), "piece": pa.array([x for _, x in out], pa.string()),
        **{n: pa.array([v if f else None for f in first], pa.int64()) for n, v in total.items()}, "audit": pa.array([audit if f else None for f in first], pa.string()),
    })


def _write_parts(batches):
    """Each segment's lines as one text; none for a segment that keeps nothing."""
    for batch in batches:
        rows = batch.to_pylist()
        lines = [list(repair(r["piece"], [(i, f.strip("-"), c) for i, f, c in zip(r["initials"], r["faults"], r["copies"], strict=True)], list(zip(r["roles"], r["texts"], strict=True)), r["before"])) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(["\n".join(x) if x else None for x in lines], pa.large_string())], ["conv_id", "seq", "part"])


def _hash_parts(batches):
    """The SHA-256 of each conversation's parts in order; what is held is one part and the hash's state."""
    state, kind, out = None, None, []
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    out.append((state[0], state[1].hexdigest()))
                state = [conv, hashlib.sha256(), False]
            if part is not None:
                state[1].update((b"\n" if state[2] else b"") + part.encode())
                state[2] = True
    if state is not None:
        out.append((state[0], state[1].hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], ["conv_id", "repaired_sha256"])


def _long(rows: DataFrame, segment_rows: int, segment_chars: int, written: list[DataFrame]) -> DataFrame:
    """The results of long conversations; equal rows of one turn are one row with copies."""
    merged = stored(rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("int").alias("copies")), "long-rows")
    marked = _marked(merged).withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn")).withColumn("key", F.md5(F.col("text").cast("binary")))
    firsts = marked.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("key").alias("f_key")).agg(F.min("at").alias("f_at"))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("key") == F.col("f_key"))
    faulty = stored(marked.join(firsts, same).select("conv_id", "turn", "role", "text", "copies", "fault", (F.col("at") == F.col("f_at")).alias("first")), "long-faults")
    dealt = faulty.repartitionByRange(*_order(faulty)).sortWithinPartitions(*_order(faulty)).select("conv_id", "role", "text", "copies", "fault", "first")
    parts = stored(dealt.mapInArrow(_segments(segment_rows, segment_chars), _typed(rows, _SEGMENT)), "long-segments")
    numbers = ["blank", "duplicate", "truncated", "illegal"]
    path = stored(parts.select("conv_id", "seq", "head", "tail", *numbers, "paths").groupBy("conv_id").applyInArrow(_compose, _typed(rows, "seq long, before string, piece string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")), "long-path")
    lines = parts.drop(*numbers).join(path.select("seq", "before", "piece"), "seq").select("conv_id", "seq", "initials", "faults", "copies", "roles", "texts", "before", "piece")
    text = lines.mapInArrow(_write_parts, _typed(rows, "seq long, part string"))
    hashed = text.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "part").mapInArrow(_hash_parts, _typed(rows, "repaired_sha256 string")).withColumnRenamed("conv_id", "h_conv")
    gaps = merged.groupBy(F.col("conv_id").alias("g_conv")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    out = path.where("cost is not null").join(hashed, F.col("conv_id").eqNullSafe(F.col("h_conv"))).join(gaps, F.col("conv_id").eqNullSafe(F.col("g_conv")))
    written += [merged, faulty, parts, path]
    return out.select("conv_id", *_NUMBERS, "audit", "repaired_sha256")


def repair_conversations(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row a conversation: its faults, the least cost and audit of a repair, and the hash of the repaired text.

    rows: conv_id, turn, role, text, copies, as ``damaged`` gives them (other columns are
    left out); copies repeat a row next to itself, and a conversation whose rows all have
    none gets zeros and empty texts. Rows go by turn, nulls first, equal turns by role
    and text. A null conv_id is one conversation. Roles count by their first letter; one
    that is neither s, u nor a can only be changed or deleted. Texts may be of any
    length. Conversations beyond long_rows rows or long_chars characters are cut into
    segments over many tasks. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    size = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = stored(size.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(F.col("conv_id").alias("l_conv")), "long-conversations")
    any_long = bool(long.limit(1).count())
    here = F.col("conv_id").eqNullSafe(F.col("l_conv"))
    short = rows.join(long, here, "left_anti") if any_long else rows
    dealt = _marked(short).repartition(default_partitions(spark), "conv_id")
    out = dealt.sortWithinPartitions(*_order(dealt)).select("conv_id", "turn", "role", "text", "copies", "fault").mapInArrow(_whole, _typed(rows, _RESULT))
    written = [long]
    if any_long:
        out = stored(out.unionByName(_long(rows.join(long, here, "left_semi"), segment_rows, segment_chars, written)), "conversations-result")
    discard(*written) if any_long else discard(long)
    return out
