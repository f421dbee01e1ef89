"""From raw documents to packed training sequences, one table per stage.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. All but the last
give the columns of documents: quality rules and near duplicates take rows away, personal data changes texts,
mixing gives parts of documents as often as the target weights ask, packing lays their tokens into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from periodica.functions.records import release, stage, staged_tables
from periodica.llm import jaccard, mixing, packing, pii, quality_rules


Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidy(step: Step) -> Step:
    """The step, after it has removed the tables that steps before it staged, unless ``docs`` still reads them."""
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        read = set(docs.inputFiles())
        release(spark, [p for p in _HELD.get(app, ()) if not any(p in f for f in read)])
        before = set(staged_tables(spark))
        out = step(spark, docs, sf_dir)
        _HELD[app] = [*[p for p in _HELD.get(app, ()) if p in before],
                      *[p for p in staged_tables(spark) if p not in before]]
        return out

    return run_step


#: What steps have staged and their result may still read, by application.
_HELD: dict[str, list[str]] = {}


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_each(docs)


@tidy
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mix),
    ("packing", pack),
]

#: The stages learn models and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
        release(spark, done)
        done = staged_tables(spark)[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
