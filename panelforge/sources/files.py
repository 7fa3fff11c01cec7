"""File sources and sinks: CSV, JSON documents, Parquet, SQL dumps, swaps and partitions."""

from __future__ import annotations

import json
import re
import time
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType, StructType

from panelforge.sources.quoted_csv import read_quoted_csv
from panelforge.storage import discard, stored


def read_text_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as text, nulls as empty strings. With multiline quoted cells may hold line ends; splits stay parallel (see quoted_csv)."""
    if multiline:
        return read_quoted_csv(spark, path)
    return spark.read.csv(path, header=True, escape='"', inferSchema=False).na.fill("")


def read_typed_csv(spark: SparkSession, path: str, schema: str | StructType, columns: list[str] | None = None, header: bool = True) -> DataFrame:
    """Typed scan in parallel splits; rows that do not parse are dropped."""
    kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    df = spark.read.schema(kinds.add("_bad", "string")).csv(path, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", encoding="UTF-8")
    names = [f for f in kinds.names if f != "_bad"]
    # always true; names the columns, for without any of them Spark refuses to read the mark of bad rows
    parsed = F.length(F.concat_ws("", *[F.col(f"`{n}`").cast("string") for n in names])) >= 0
    return df.where(F.col("_bad").isNull() & parsed).select(columns or names)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: csv, json, jsonl, parquet."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_text_csv(spark, path, multiline=True)
    if suffix in ("json", "jsonl", "ndjson"):
        return spark.read.json(path, multiLine=suffix == "json")
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown suffix: {suffix}")


def read_folder(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """A folder tree with file_path and row order, for first-come rules."""
    df = spark.read.format(fmt).options(recursiveFileLookup=True, **options).load(path)
    found = df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("rf_block"))
    # how splits are packed into tasks does not matter: by file, place of the split in it, and row of the split
    return found.withColumn("row_order", F.struct("file_path", "rf_block", F.monotonically_increasing_id().alias("row"))).drop("rf_block")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file; files that do not parse are left out."""
    return spark.read.schema(StructType.fromDDL(schema)).json(path, multiLine=True, mode="DROPMALFORMED")


def _files(spark: SparkSession, path: str):
    """The store of a path, and how to name paths in it."""
    named = spark._jvm.org.apache.hadoop.fs.Path
    return named(path).getFileSystem(spark._jsc.hadoopConfiguration()), named


def swap_parquet(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap by two renames; the old table goes last, and comes back if the second rename fails.

    A reader that lists the folder between the renames finds none; it never finds half a table.
    """
    spark = df.sparkSession
    staging, old = f"{path}__staging", f"{path}__old"
    df.write.mode("overwrite").parquet(staging)
    fs, named = _files(spark, path)
    fs.delete(named(old), True)
    had = fs.exists(named(path))
    if had and not fs.rename(named(path), named(old)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(named(staging), named(path)):
        if had:
            fs.rename(named(old), named(path))
        raise OSError(f"cannot rename {staging}")
    fs.delete(named(old), True)


def write_by_year(df: DataFrame, path: str, date: str = "date", tasks: int = 8) -> None:
    """Partitions by year, only those written are replaced: writing twice does not double rows. A year is dealt to several tasks by its dates."""
    parts = df.withColumn("year", F.year(date))
    parts.repartition("year", F.pmod(F.xxhash64(date), F.lit(tasks))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def keys_to_meet(store: DataFrame, batch: DataFrame, key: str) -> DataFrame | None:
    """The store's keys (an_key) between the batch's least and greatest, and its null keys if the batch has any; None if the batch is empty.

    The bounds reach the scan, so row groups outside them are skipped. Keys of other types than whole numbers, texts and dates are all read.
    """
    least, most, nulls = batch.agg(F.min(key), F.max(key), F.count_if(F.col(key).isNull())).first()
    if least is None and not nulls:
        return None
    wanted = F.col(key).isNull() if nulls else F.lit(False)
    if least is not None:
        kind = batch.schema[key].dataType
        bounded = isinstance(kind, (IntegralType, StringType, DateType)) and kind == store.schema[key].dataType
        wanted = wanted | (F.col(key).between(F.lit(least), F.lit(most)) if bounded else F.col(key).isNotNull())
    return store.where(wanted).select(F.col(key).alias("an_key"))


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key is not in the store yet; a null key counts as one more key.

    Files are sorted by key, and of the store only the key column is read, in row groups that meet the batch's range:
    with ids that grow over time a batch costs the same however large the store is. Of rows with the same key one is kept.
    """
    spark = df.sparkSession
    fs, named = _files(spark, path)
    if not fs.exists(named(path)):
        df.dropDuplicates([key]).sortWithinPartitions(key).write.mode("append").parquet(path)
        return
    batch = stored(df, "append-batch")  # read twice: bounds and rows must be of the same rows
    have = keys_to_meet(spark.read.parquet(path), batch, key)
    if have is not None:
        fresh = batch.dropDuplicates([key]).join(have, F.col(key).eqNullSafe(F.col("an_key")), "left_anti")
        fresh.sortWithinPartitions(key).write.mode("append").parquet(path)
    discard(batch)


def write_plain(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """CSV with a header, or Parquet, as many files as there are partitions."""
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file in any store, by way of a name beside it, so readers see it whole."""
    fs, named = _files(spark, path)
    fs.mkdirs(named(path).getParent())
    out = fs.create(named(f"{path}.tmp"), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(named(path), False)
    if not fs.rename(named(f"{path}.tmp"), named(path)):
        raise OSError(f"cannot write {path}")


def write_json_document(spark: SparkSession, path: str, document: dict) -> None:
    """A finished report, indented; values that JSON does not know become text."""
    write_text(spark, path, json.dumps(document, indent=2, default=str, ensure_ascii=False))


def markdown_table(rows: list, columns: list[str], digits: int = 4) -> str:
    """A report's table from a few collected rows; missing values are a dash."""

    def cell(v) -> str:
        return "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = [columns, ["---"] * len(columns), *([cell(r[c]) for c in columns] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def read_day_documents(spark: SparkSession, root: str, day: date, schema: str, look_back: int = 5, latest_first: bool = True) -> DataFrame:
    """JSON documents of the newest day folder (root/YYYY-MM-DD) that has any, at most look_back days back; with day, path and modified.

    Files that do not parse are left out. An empty frame if no folder is there.
    """
    fs, named = _files(spark, root)
    for back in range(look_back + 1):
        folder = f"{root}/{(day - timedelta(days=back)).isoformat()}"
        if fs.exists(named(folder)) and any(f.getPath().getName().endswith(".json") for f in fs.listStatus(named(folder))):
            found = spark.read.schema(StructType.fromDDL(schema)).json(folder, multiLine=True, mode="DROPMALFORMED", pathGlobFilter="*.json")
            marked = found.select("*", F.lit((day - timedelta(days=back)).isoformat()).cast("date").alias("day"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
            return marked.orderBy(F.col("path").desc()) if latest_first else marked
    return spark.createDataFrame([], StructType.fromDDL(f"{schema}, day date, path string, modified timestamp"))


def folder_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, n_files, n_bytes, newest) of a folder tree; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy(suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"), F.max("modificationTime").alias("newest"))


def is_fresh(spark: SparkSession, path: str, hours: float) -> bool:
    """Whether the newest file of a cached table is younger than that many hours; false where there is none."""
    fs, named = _files(spark, path)
    if not fs.exists(named(path)):
        return False
    newest = max((f.getModificationTime() for f in fs.listStatus(named(path))), default=0)
    return time.time() - newest / 1000 < hours * 3600


def read_factors(spark: SparkSession, path: str, names: tuple[str, ...] = ("mkt_rf", "smb", "hml")) -> DataFrame:
    """Monthly factors from a CSV (month as YYYY-MM or YYYYMM, values in percent): month as a date, values as fractions."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    month = F.to_date(F.concat(F.substring(F.regexp_replace(F.trim("month"), "-", ""), 1, 6), F.lit("01")), "yyyyMMdd")
    return raw.select(month.alias("month"), *[(F.col(n).try_cast("double") / 100).alias(n) for n in names]).where("month is not null")


def coverage(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: first and last date, and the share of the universe that has bars."""
    marked = universe.select("ticker").distinct().withColumn("cv_wanted", F.lit(1)).join(bars.groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi")), "ticker", "left")
    return marked.agg(F.min("lo").alias("date_min"), F.max("hi").alias("date_max"), F.try_divide(F.count("lo").cast("double"), F.count(F.lit(1))).alias("share"))


def covers(found: DataFrame, start: date, end: date, least: float = 0.95) -> bool:
    """Whether coverage() reaches over the dates and has enough of the universe."""
    r = found.first()
    return r.date_min is not None and r.date_min <= start and r.date_max >= end and r.share >= least


#: One value of a dump: quoted (a backslash escapes the next character, a doubled quote is one) or bare. Possessive, so long lines need no stack.
_QUOTED = r"'(?:[^'\\]++|\\.|'')*+'"


def read_dump(spark: SparkSession, path: str, table: str, ordinals: dict[str, int]) -> DataFrame:
    """Columns by ordinal from the INSERT lines of one table of a SQL dump."""
    lines = spark.read.text(path).where(F.col("value").startswith(f"INSERT INTO `{table}`"))
    return dump_rows(lines, "value", ordinals)


def dump_rows(lines: DataFrame, column: str, ordinals: dict[str, int]) -> DataFrame:
    """Tuples of INSERT lines as text columns by ordinal, NULL as null; a backslash escapes the next character as it is."""
    body = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?is)^.*?\bVALUES", "")
    tuples = F.regexp_extract_all(body, F.lit(rf"(?s)\(((?:{_QUOTED}|[^()'])*+)\)"), F.lit(1))
    cells = F.regexp_extract_all("dr_tuple", F.lit(rf"(?s)({_QUOTED}|[^,']++)"), F.lit(1))

    def plain(cell):
        bare = F.trim(cell)
        inner = F.regexp_replace(F.substring(cell, F.lit(2), F.length(cell) - 2), r"(?s)\\(.)|'(')", "$1$2")
        return F.when(cell.startswith("'"), inner).when(F.upper(bare) != "NULL", bare)

    rows = lines.select(F.explode(tuples).alias("dr_tuple")).select(F.transform(F.filter(cells, lambda c: F.trim(c) != ""), plain).alias("fields"))
    return rows.select([F.get("fields", F.lit(i)).alias(n) for n, i in ordinals.items()])


def html_universe(pages: DataFrame, html: str = "html") -> DataFrame:
    """First cells of the rows of the table with id constituents (of the first table, if none has it), as tickers."""
    page = F.coalesce(F.col(html), F.lit(""))
    named = F.regexp_extract(page, r'(?is)<table[^>]*id="constituents".*?</table>', 0)
    table = F.when(named != "", named).otherwise(F.regexp_extract(page, r"(?is)<table.*?</table>", 0))
    cells = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>"), F.lit(1))
    return pages.select(F.explode(cells).alias("cell")).select(F.replace(F.trim(F.regexp_replace("cell", r"<[^>]+>", "")), F.lit("."), F.lit("-")).alias("ticker")).where("ticker <> ''")
