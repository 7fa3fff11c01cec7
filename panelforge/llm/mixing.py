"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import default_partitions, stored

#: Rates are broadcast while their distribution functions have so many entries in all (8 bytes each); beyond, the join is shuffled over salts.
BROADCAST_ENTRIES = 1_000_000
SALTS = 64
#: 13 hexadecimal digits of md5: 52 bits, exact in a double.
_UNIT = float(1 << 52)


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, total: float | None = None) -> DataFrame:
    """One row per source: mean repetition rate, and the Poisson distribution function up to where it is 1.

    weights: target shares by source name; a source not named gets 0. Without them a
    source's weight is its row count to the power ``temperature``. total: rows wanted
    (as many as there are, if none). A null source is one source of its own, with
    the name null in the result. Rates are found from exact counts over all rows.
    """
    counts = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        weight = F.pow("n", F.lit(temperature))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("mix_source")) if weights else F.lit(None).cast("double"), F.lit(0.0)).cast("double")
    counts = stored(counts.withColumn("w", weight), "mix-counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("rows"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("sum_w")).first()
    wanted = float(total) if total is not None else whole.rows
    rated = counts.withColumn("rate", F.coalesce(F.try_divide(F.lit(wanted) * F.col("w"), F.lit(whole.sum_w) * F.col("n")), F.lit(0.0)))
    # log p(k) = -rate + k log(rate) - log k!, summed up to where the tail is under 2^-52
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    upto = Window.partitionBy("mix_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = rated.where("rate > 0").select("mix_source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    log_p = F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(F.greatest("k", F.lit(1)).cast("double")))).over(upto)
    cdf = steps.withColumn("p", F.exp(log_p)).withColumn("cdf", F.sum("p").over(upto)).groupBy("mix_source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"]).alias("mix_cdf"))
    cdf = cdf.withColumnRenamed("mix_source", "of_source")
    out = rated.join(cdf, F.col("mix_source").eqNullSafe(F.col("of_source")), "left")
    return out.select("mix_source", F.col("rate").alias("mix_rate"), F.coalesce("mix_cdf", F.array(F.lit(1.0))).alias("mix_cdf"))


def poisson_count(cdf: Column, unit: Column) -> Column:
    """How many entries of a rising array are at most unit, by bisection."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cdf) + 1.0)).cast("int") + 1)

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        low = F.coalesce(F.get(cdf, mid) <= unit, F.lit(False))
        open_ = at["lo"] < at["hi"]
        return F.struct(F.when(open_ & low, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(open_ & ~low, mid).otherwise(at["hi"]).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cdf).alias("hi")), halve, lambda at: at["lo"])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, total: float | None = None, seed: int = 17) -> DataFrame:
    """Each document as often as a Poisson variable with its source's rate says, in a global random order.

    Adds mix_copy (from 1), mix_copies and mix_key; rows lie in partitions by mix_key
    and are sorted by it inside. The variable comes from md5(seed:id), so a run can be
    repeated and equal ids get equal counts. A null id hashes as the text "null". A
    document may come out 0 times: that is the sampling asked for. Repeated rows are
    drawn alike. Texts are never looked at, so null, empty and very long ones are as any
    other. Rows with equal keys lie in no fixed order. An empty table gives an empty
    result. Columns of docs with these names (mix_copy, mix_copies, mix_key, mix_source,
    mix_rate, mix_cdf, mix_unit, mix_salt) are replaced.
    """
    rates = stored(source_rates(docs, source_col, weights, temperature, total), "mix-rates")
    entries = rates.agg(F.coalesce(F.sum(F.size("mix_cdf") + 4), F.lit(0))).first()[0]
    docs = docs.drop("mix_copy", "mix_copies", "mix_key", "mix_source", "mix_rate", "mix_cdf", "mix_unit", "mix_salt")
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, 13), 16, 10).cast("double") / F.lit(_UNIT)
    if entries <= BROADCAST_ENTRIES:
        joined = docs.join(F.broadcast(rates), docs[source_col].eqNullSafe(rates["mix_source"]))
    else:
        salted = docs.withColumn("mix_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        spread = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("mix_salt", F.col("mix_salt").cast("long"))
        joined = salted.join(spread, salted[source_col].eqNullSafe(spread["mix_source"]) & (salted["mix_salt"] == spread["mix_salt"])).drop(spread["mix_salt"]).drop("mix_salt")
    counted = joined.withColumn("mix_unit", unit).withColumn("mix_copies", poisson_count(F.col("mix_cdf"), F.col("mix_unit")))
    copies = counted.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(str(seed)), named, F.col("mix_copy").cast("string"))))
    out = keyed.drop("mix_source", "mix_rate", "mix_cdf", "mix_unit").repartition(default_partitions(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")
    return out
