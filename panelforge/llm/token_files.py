"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but 2-byte little-endian token ids, each document closed by
the end-of-document id. Spark's text reader cuts files of any size into byte ranges at
a fixed byte, so one file is read by many tasks. Each range streams by in blocks;
one vectorised comparison finds the end id's bytes in a block, at even or odd places,
since a block does not know how many bytes lie before it. A prefix scan over the
blocks' sizes tells which places are whole tokens, and another one carries documents
that cross blocks (or files).
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import fresh_path, placed, shuffles_removed, stored

END_ID = 50256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a tiktoken file, read on the driver and sent along (about a megabyte)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def write_token_files(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, path: str | None = None) -> str:
    """Write the texts as flat token files, one for each input partition, in row order; returns the folder.

    A row's bytes are its tokens and the line separator is the end-of-document id, so
    Spark's own writer makes the files in any store. A null text has no tokens.
    """
    path = path or fresh_path(docs.sparkSession, "tokens")
    ranks = read_ranks(vocabulary)
    if max(ranks.values()) >= 1 << 16 or end_id in ranks.values():
        raise ValueError("token ids must fit in two bytes and leave the end id free")

    def run(batches):
        encode = _encoder(ranks).encode_ordinary
        for batch in batches:
            tokens = [np.array(encode(t), "<u2").tobytes() if t else b"" for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary())], ["value"])

    separator = np.array([end_id], "<u2").tobytes().decode("latin-1")
    encoded = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    with shuffles_removed(docs.sparkSession):
        encoded.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)
    return path


def _blocks(end_id: int, cut: int):
    """Per block of a byte range: its bytes, and where in it the end id's bytes stand, at any alignment.

    Records are what lies between two cut bytes. The end id holds no cut byte, so it
    never crosses records.
    """
    low, high = end_id & 255, end_id >> 8

    def run(batches):
        last, seq = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, starts = batch.column(0), batch.column(1).to_numpy()
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = (starts[1:] != starts[:-1]) | pa.compute.not_equal(paths.slice(1), paths.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(fresh)
            for at, stop in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                here = (paths[int(at)].as_py(), int(starts[at]))
                seq = seq + 1 if here == last else 0
                last = here
                data = np.frombuffer(bytes([cut]).join([*batch.column(3).slice(at, stop - at).to_pylist(), b""]), np.uint8)
                hits = np.flatnonzero((data[:-1] == low) & (data[1:] == high))
                yield pa.RecordBatch.from_arrays([pa.array([here[0]]), pa.array([here[1]], pa.int64()), pa.array([seq], pa.int64()), pa.array([batch.column(2)[int(at)].as_py()], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([hits], pa.list_(pa.int64()))], ["path", "start", "seq", "size", "bytes", "hits"])

    return run


def scan_token_files(spark: SparkSession, path: str, end_id: int = END_ID) -> DataFrame:
    """(path, ordinal, n_tokens, closed): documents by the file that closes them, in file order.

    Files are read once, in byte ranges, and count in the order of their paths as one
    stream. Tokens behind the last separator of all are one open document (closed =
    false). An empty file or folder adds nothing. A document may be of any length.
    What must fit in memory is the stretch between two cut bytes, a few hundred bytes
    in text's tokens.
    """
    cut = next(b for b in (10, 11, 12) if b not in (end_id & 255, end_id >> 8))
    lines = spark.read.option("lineSep", chr(cut)).text(path)
    ranges = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    blocks = stored(ranges.mapInArrow(_blocks(end_id, cut), "path string, start long, seq long, size long, bytes long, hits array<long>"), "token-blocks")
    upto = Window.partitionBy("path").orderBy("start", "seq")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    at = blocks.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    # token numbers of the separators; half ones are two other tokens' bytes
    at = at.withColumn("ends", F.transform(F.filter("hits", lambda h: (h + F.col("offset")) % 2 == 0), lambda h: F.shiftright(h + F.col("offset"), 1))).drop("hits")
    at = at.withColumn("first", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long")).withColumn("open_from", F.coalesce(F.max(F.get("ends", F.size("ends") - 1)).over(before) + 1, F.lit(0)))
    at = stored(at.select("path", "size", "first", "open_from", "ends"), "token-ends")
    by_file = at.groupBy("path").agg((F.first("size") / 2).cast("long").alias("tokens"), F.sum(F.size("ends")).alias("n"), F.max(F.get("ends", F.size("ends") - 1)).alias("last"))
    by_file = by_file.withColumn("open", F.col("tokens") - F.coalesce(F.col("last") + 1, F.lit(0)))
    over = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)  # one row for each file
    by_file = by_file.withColumn("run", F.sum((F.col("n") > 0).cast("int")).over(over))
    by_file = by_file.withColumn("sum_open", F.sum("open").over(Window.partitionBy("run").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)))
    by_file = by_file.withColumn("carry", F.coalesce(F.lag("sum_open").over(Window.orderBy("path")), F.lit(0))).withColumn("is_last", F.lead("path").over(Window.orderBy("path")).isNull())
    by_file = stored(by_file.select("path", "n", "sum_open", "carry", "is_last"), "token-files")
    closing = at.where(F.size("ends") > 0).join(by_file.select("path", "carry"), "path")
    gaps = F.transform("ends", lambda e, i: F.struct((F.col("first") + i).alias("ordinal"), (e - F.when(i == 0, F.col("open_from") - F.when(F.col("first") == 0, F.col("carry")).otherwise(0)).otherwise(F.get("ends", i - 1) + 1)).alias("n_tokens")))
    closed = closing.select("path", F.inline(gaps)).select("path", "ordinal", "n_tokens", F.lit(True).alias("closed"))
    left = by_file.where(F.col("is_last") & (F.col("sum_open") > 0)).select("path", F.col("n").cast("long").alias("ordinal"), F.col("sum_open").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(left)


def count_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id and n_tokens of every row, counted in the token files that this writes first.

    Files and ids pair up by input partition and row order, so an input that is not a
    plain scan is written out first; it is checked that each file closes as many
    documents as its partition has rows. A null or empty text has 0 tokens. A text of
    any length is read whole. Repeated rows each get a row; ties cannot occur. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = placed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    path = write_token_files(docs, "text", vocabulary)
    number = F.regexp_extract("path", r"part-(\d+)-", 1).cast("int").alias("part")
    counted = scan_token_files(spark, path).select(number, "ordinal", "n_tokens", "closed")
    rows = docs.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("ordinal"))
    joined = rows.join(counted, ["part", "ordinal"], "full")
    checked = F.when(F.col("n_tokens").isNotNull() & F.coalesce("closed", F.lit(False)), F.col("n_tokens")).otherwise(F.raise_error(F.lit("token files do not match the documents' partitions")).cast("long"))
    return joined.select(F.col("id").alias(id_col), checked.alias("n_tokens"))
