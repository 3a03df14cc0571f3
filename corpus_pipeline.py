"""A training corpus in five stages: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes what its predecessor kept. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import lines, mixing, packing, quality, simhash
from logweir.llm.common import checkpointed, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go.

    Null and empty texts have no words and go; a repeated row shares its twin's verdict; other
    columns stay, whatever their names; of no documents none are left.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; n_chars follows the text.

    No document goes. A null text stays null, an empty one empty; a row that is repeated counts
    each time; n_chars is left as it is where the column is absent; other columns stay.
    """
    cut = lines.LineIndex.empty(spark).insert(docs).drop_common(docs)
    if "n_chars" not in cut.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (5-word shingles, similarity 0.8) stays.

    It is the one of the smallest doc_id (nulls last, then by text). Null, empty and blank texts
    are one class; of equal rows one stays; other columns stay, whatever their names.
    """
    return simhash.drop_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them.

    Texts without words are taken not at all; a null source is a source of its own; rows of one
    id, size and source are taken alike; other columns stay, whatever their names.
    """
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens.

    A null or empty text is its end token; a long one is cut into windows; repeated rows are
    packed separately; other columns go.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("packing", packing_stage),
]

#: SQL has neither the near copies nor the tokenizer; test_pipeline_against_brute_force holds the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
