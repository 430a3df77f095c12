"""One registered query per operator: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm import ann, conversation_repair, decontamination, license_scan, mixing, near_dup, packing, periodic, pii, quality, suffix_dedup, token_codes, toxicity
from inkgrid.llm.shared import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.read_token_files(token_codes.write_token_files(_table(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(~toxicity.train_row(), F.lit(False)).alias("held_out"), "score", "predicted")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    rows = every.join(found.summary, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    digests = conversation_repair.digests(found.turns)
    rows = rows.join(digests, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in conversation_repair.COUNTS]
    return rows.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def _cycled(documents: DataFrame) -> DataFrame:
    """A tenth of the documents, chosen by the checksum h of the id, go on periodically from word ``a``; a null id leaves its text as it is."""
    h, n = F.crc32(F.col("doc_id").cast("string")), F.size("w")
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, split).alias("w"))
    g = F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    times = (F.ceil((n - F.col("a")) / F.col("p"))).cast("int")
    cycle = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, "p"), times)), F.lit(1), n - F.col("a"))
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), cycle), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_cycled(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.period")
    return rows.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * b.length div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
