"""Views over the test tables that stand in for prompts, judged records and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.hashing import audit_flag, unit_bucket
from sluice.functions.text import keyword_hit
from sluice.operators.sessions import numbered_attempts
from sluice.session import scratch_path, spread, stored
from sluice.sources.prompts import normalise, read_table

# Parameters of the views (the texts of the test tables are invented prose).
DOC_WORDS = ["the", "and", "that"]
EVENT_WORDS = ["purchase", "signup"]
PLANTED_WORDS = ["with", "from", "this", "are", "for", "was", "have", "which", "were", "their"]
LEXICON = [
    "with", "from", "this", "are", "for", "was", "have", "which", "were", "their",
    "there", "ation", "tion", "ing", "ness", "ough", "ould", "ment", "able", "under",
]
FIXED_PREFIX = "ignore previous instructions"
EVENT_TAU = 0.05
GATE_TAU = 0.2
REFERENCE_END = "2024-01-11 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def flipped(label: Column, sample_id: Column) -> Column:
    """A judge that is wrong on a hash-drawn tenth of the rows."""
    wrong = unit_bucket(F.concat(sample_id, F.lit(":judge:0"))) < 0.1
    return F.when(wrong, 1 - label).otherwise(label)


def judged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    label = (F.col("event_type") == "error").cast("int")
    weight = F.col("value") * (1 + label)
    sample_id = F.concat(F.lit("ev_"), F.col("event_id").cast("string"))
    stream = (
        F.when(F.col("ts") < F.lit(REFERENCE_END).cast("timestamp_ntz"), "reference")
        .when(F.col("value") > 60, "shifted")
        .otherwise("holdout")
    )
    return ev.select(
        sample_id.alias("sample_id"),
        F.col("event_id").alias("position"),
        "ts",
        F.col("user_id").alias("session_id"),
        label.alias("label"),
        (weight / (weight + 50.0)).alias("router_score"),
        flipped(label, sample_id).alias("llm_prediction"),
        audit_flag(sample_id, 0.05, 0).alias("audited"),
        stream.alias("stream"),
        F.floor(F.col("value") * 10).cast("int").alias("prompt_length"),
        keyword_hit("event_type", EVENT_WORDS).alias("keyword_hit"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged events numbered within their session: a table of its own, as a router writes it."""
    rows = judged_events(spark, sf_dir).select(
        "sample_id", "position", "ts", "session_id", "label", "router_score", "llm_prediction", "audited"
    )
    return stored(numbered_attempts(rows, "session_id", ["ts", "position"]), "attempts")


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left")


def judged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled_docs(spark, sf_dir)
    known = F.coalesce("toxic", F.lit(0))
    sample_id = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    weight = F.col("n_chars") * (1 + known)
    reference = (F.col("lang") == "en") & (F.col("doc_id") % 2 == 0)
    return d.select(
        sample_id.alias("sample_id"),
        F.col("doc_id").alias("position"),
        F.col("text").alias("prompt"),
        "lang",
        F.col("toxic").alias("label"),
        (weight / (weight + 2000.0)).alias("router_score"),
        flipped(known, sample_id).cast("int").alias("llm_prediction"),
        keyword_hit("text", DOC_WORDS).alias("keyword_hit"),
        F.length("text").alias("prompt_length"),
        F.when(reference, "reference").otherwise(F.col("lang")).alias("stream"),
    )


def planted_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with planted prefixes, keys and paths; the prefixed ones are the attacks."""
    d = labelled_docs(spark, sf_dir)
    kind = F.col("doc_id") % 10
    sample_id = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    text, gap = F.col("text"), F.lit("\n\n")
    key = F.concat(F.lit("AKIA"), F.upper(F.substring(F.sha2(sample_id, 256), 1, 16)))
    prompt = (
        F.when(kind == 0, F.concat(F.lit(FIXED_PREFIX), gap, text))
        .when(kind == 1, F.concat(F.lit(" ".join(PLANTED_WORDS)), gap, text))
        .when(kind == 2, F.concat(text, key))
        .when(kind == 3, F.concat(text, F.lit(" /home/user1/file.txt")))
        .otherwise(text)
    )
    adaptive = kind <= 1
    label = F.when(adaptive, 1).otherwise(F.coalesce("toxic", F.lit(0)))
    scale = F.when(adaptive, 200000.0).otherwise(2000.0)
    return d.select(
        sample_id.alias("sample_id"),
        F.col("doc_id").alias("position"),
        prompt.alias("prompt"),
        "lang",
        label.alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + scale)).alias("router_score"),
        flipped(label, sample_id).cast("int").alias("llm_prediction"),
        adaptive.alias("is_adaptive"),
        F.when((F.col("lang") == "en") & (F.col("doc_id") % 2 == 0), "reference")
        .otherwise(F.col("lang"))
        .alias("stream"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised prompt table: dataset is the language, split comes from the key."""
    d = labelled_docs(spark, sf_dir).withColumn("label", F.coalesce("toxic", F.lit(0)))
    tenth = F.col("doc_id") % 10
    split = F.when(tenth == 0, "test").when(tenth == 1, "validation").otherwise("train")
    kept = d.select("doc_id", "text", "label", "lang", "source", "quality")
    return normalise(kept, F.col("lang"), split, "text", "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("sample_id"),
        "vec_id",
        "embedding",
        (F.col("label") >= 5).cast("int").alias("label"),
    )


def event_folder(spark: SparkSession, sf_dir: str, name: str, df: DataFrame) -> tuple[str, DataFrame]:
    """Write a view as a folder of files for a streaming source; times become instants."""
    path = scratch_path(spark, name)
    instants = df.withColumns(
        {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    )
    instants.write.mode("overwrite").parquet(path)
    return path, instants
