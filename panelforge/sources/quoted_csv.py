"""CSV with line ends inside quotes, read in parallel splits.

A reader that may meet a quoted line end cannot know at a split whether it starts
inside quotes, so Spark's own gives such a file to one task. Here every line is first
reduced to what it does to that one bit: a map from (outside, inside) before it to
(outside, inside) after it. A split's lines compose to the split's map, the maps of a
file's splits compose in a prefix scan, and so each split learns how it starts and
the number of its first record. A second pass then puts the lines of records together
where they are; only the pieces of records that cross a split are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelforge.storage import stored

#: Longer records count as malformed: what follows an unclosed quote, as a rule.
MOST_CHARS = 64 << 20
#: More splits than this are joined instead of broadcast.
MOST_BROADCAST = 500_000


def _patterns(sep: str) -> tuple[str, str]:
    """Lines that end inside quotes, from outside and from inside; a quote counts at the start of a cell only, a doubled one inside is text."""
    s = "\\" + sep if not sep.isalnum() else sep
    quoted = '"[^"]*+(?:""[^"]*+)*+'
    cells = rf'(?:(?:{quoted}"[^{s}]*+|[^"{s}][^{s}]*+)?{s})*+'
    return rf"(?s)^{cells}{quoted}$", rf'(?s)^[^"]*+(?:""[^"]*+)*+(?:$|"[^{s}]*+{s}{cells}{quoted}$)'


def _effects(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether the line ends inside quotes if it starts outside, and if it starts inside."""
    outside, inside = _patterns(sep)
    plain = ~F.contains(line, F.lit('"'))
    return F.when(plain, False).otherwise(line.rlike(outside)), F.when(plain, True).otherwise(line.rlike(inside))


def _after(from_out: np.ndarray, from_in: np.ndarray, start: bool) -> np.ndarray:
    """The bit after each line: the last line that fixes it, turned by the lines behind that one that swap it."""
    at = np.arange(len(from_out))
    fixed = np.maximum.accumulate(np.where(from_out == from_in, at, -1))
    swaps = np.cumsum(from_out & ~from_in)
    base = np.where(fixed >= 0, from_out[fixed], start)
    return base ^ ((swaps - np.where(fixed >= 0, swaps[fixed], 0)) & 1).astype(bool)


def _runs(batch: pa.RecordBatch):
    """(file, block, first row, end) of the splits that follow each other in a batch."""
    if not batch.num_rows:
        return
    files, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    start = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or files[i] != files[start] or blocks[i] != blocks[start]:
            yield files[start], int(blocks[start]), start, i
            start = i


def _flags(batch: pa.RecordBatch, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(i).slice(first, end - first).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3))


def _split_maps(batches):
    """One row a split: the bit at its end and its number of records, from outside and from inside."""
    now = None

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(("file", "block", "end_out", "end_in", "n_out", "n_in"), now, strict=True))], pa.schema([("file", pa.string()), ("block", pa.int64()), ("end_out", pa.bool_()), ("end_in", pa.bool_()), ("n_out", pa.int64()), ("n_in", pa.int64())]))

    for batch in batches:
        for file, block, first, end in _runs(batch):
            if now is None or now[:2] != [file, block]:
                if now is not None:
                    yield row()
                now = [file, block, False, True, 0, 0]
            effects = _flags(batch, first, end)
            for i in (0, 1):
                bits = _after(*effects, now[2 + i])
                # a record starts with every line that starts outside
                now[4 + i] += int(not now[2 + i]) + int((~bits[:-1]).sum())
                now[2 + i] = bool(bits[-1])
    if now is not None:
        yield row()


def _split_starts(table: pa.Table) -> pa.Table:
    """Per file, in order of its splits: whether each starts inside quotes, and the records before it. A row a split."""
    rows, inside, records, out = sorted(table.to_pylist(), key=lambda r: r["block"]), False, 0, []
    for r in rows:
        out.append({"file": r["file"], "block": r["block"], "inside": inside, "records": records})
        records += r["n_in"] if inside else r["n_out"]
        inside = r["end_in"] if inside else r["end_out"]
    return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("records", pa.int64())]))


_RECORDS = "file string, record long, block long, crosses boolean, chars long, text string"


def _assembled(batches):
    """Records of each split with their number in the file; the first and the last of a split may cross into others.

    A record is held until its last line, up to MOST_CHARS; of a longer one only the length goes on.
    """
    at, part = None, None

    def closed(crosses: bool):
        if part is not None and part["n"]:
            rows.append((at[0], part["record"], at[1], crosses or part["crosses"], part["chars"], "\n".join(part["lines"]) if part["chars"] <= MOST_CHARS else None))

    def batch_of(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "record", "block", "crosses", "chars", "text"])

    for batch in batches:
        rows: list = []
        for file, block, first, end in _runs(batch):
            if at != (file, block):
                closed(inside if at is not None else False)
                at, inside, record = (file, block), batch.column(5)[first].as_py(), batch.column(6)[first].as_py() - 1
                part = {"record": record, "n": 0, "crosses": inside, "chars": 0, "lines": []}
            bits = _after(*_flags(batch, first, end), inside)
            starts = ~np.concatenate(([inside], bits[:-1]))
            numbers = record + np.cumsum(starts)
            lines = batch.column(4).slice(first, end - first)
            alone = starts & ~bits
            single = np.flatnonzero(alone)
            if len(single):
                n = len(single)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(numbers[single]), pa.array(np.full(n, block)), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, np.int64)), lines.take(pa.array(single))], ["file", "record", "block", "crosses", "chars", "text"])
            for i, line in zip(np.flatnonzero(~alone), lines.take(pa.array(np.flatnonzero(~alone))).to_pylist(), strict=True):
                if starts[i]:
                    closed(False)
                    part = {"record": int(numbers[i]), "n": 0, "crosses": False, "chars": 0, "lines": []}
                part["n"] += 1
                part["chars"] += len(line) + 1
                if part["chars"] <= MOST_CHARS:
                    part["lines"].append(line)
                else:
                    part["lines"].clear()
            inside, record = bool(bits[-1]), int(numbers[-1])
        if rows:
            yield batch_of(rows)
    rows = []
    closed(inside if at is not None else False)
    if rows:
        yield batch_of(rows)


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, record, text): the logical records of the CSV files under a path, record 0 being the first of a file.

    Bytes that are no UTF-8 are replaced. A record of more than MOST_CHARS characters is
    malformed (as a rule what follows an unclosed quote) and left out.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    scanned = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("line"))
    from_out, from_in = _effects(F.col("line"), sep)
    marked = scanned.select("file", "block", from_out.alias("from_out"), from_in.alias("from_in"), "line")
    maps = marked.select("file", "block", "from_out", "from_in").mapInArrow(_split_maps, "file string, block long, end_out boolean, end_in boolean, n_out long, n_in long")
    starts = stored(maps.groupBy("file").applyInArrow(_split_starts, "file string, block long, inside boolean, records long"), "csv-splits")
    side = F.broadcast(starts) if starts.count() <= MOST_BROADCAST else starts
    joined = marked.join(side, ["file", "block"]).select("file", "block", "from_out", "from_in", "line", "inside", "records")
    found = joined.mapInArrow(_assembled, _RECORDS)
    whole = found.where("not crosses and text is not null").select("file", "record", "text")
    # a piece a split at most, two records a split
    pieces = found.where("crosses").groupBy("file", "record").agg(F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    crossing = pieces.where(F.col("chars") <= MOST_CHARS).select("file", "record", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(crossing).withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def read_quoted_csv(spark: SparkSession, path: str, schema: str | StructType | None = None, columns: list[str] | None = None, header: bool = True, sep: str = ",") -> DataFrame:
    """The CSV files under a path in parallel splits, whatever lies inside quotes; a doubled quote is a quote.

    With a schema, rows that do not parse (a wrong number of cells, no number where one
    is due) are dropped, as are blank lines. Without one, all columns are text named by
    the header (the first line of the first file), missing ones empty.
    """
    if schema is None:
        head = spark.read.option("recursiveFileLookup", True).csv(path, header=True, escape='"', sep=sep, inferSchema=False)
        kinds = StructType.fromDDL(", ".join(f"`{c}` string" for c in head.columns))
    else:
        kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names, typed = list(kinds.names), schema is not None
    records = read_records(spark, path, sep)
    records = records.where("record > 0") if header else records
    marked = StructType(list(kinds)).add("_bad", "string")
    row = F.from_csv("text", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked), {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = records.where("trim(text) <> ''").select(row.alias("r")).select("r.*")
    if not typed:
        return parsed.select(names).na.fill("")
    return parsed.where("_bad is null").select(columns or names)
