"""A corpus pipeline: quality filter, near duplicates, decontamination, source mix, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import quality
from sluice.llm.decontaminate import Decontaminator
from sluice.llm.jaccard import one_per_component
from sluice.llm.mixing import SourceMix, mixed
from sluice.llm.queries import GOOD, SHARD_BYTES, quality_model
from sluice.llm.shared import Scratch, table
from sluice.llm.sharding import shard


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, quality_model(spark, sf_dir, docs), GOOD)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return one_per_component(docs, k=5, percent=80)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return Decontaminator().clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: weights 1, 2, 3, at most 3 times."""
    return mixed(docs, SourceMix(), F.array("source"))


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their bytes and shard."""
    return shard(docs, SHARD_BYTES)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("near_duplicates", unlike_documents),
    ("decontaminate", uncontaminated_documents),
    ("mix", mixed_documents),
    ("shard", sharded_documents),
]

#: The classifier is fitted by boosting and the mix draws by hash, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again for the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
