"""From raw documents to packed training sequences: language, quality, near duplicates, packing.

Each stage is written as Parquet into the shared folder and read again, so a lost executor never costs a finished stage. An empty
table goes through all stages and gives no rows; other columns of documents, whatever their names, come along to the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillgraph.llm import language, packing, quality_rules, simhash
from rillgraph.llm.common import cut, place, remove, scratch, table
from rillgraph.llm.queries import vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which no language holds the share that their length asks for (half of a long text), go.

    Null, empty and letterless texts go; null ids stay, repeated rows stay as often; without any learned language all go.
    """
    return language.keep(docs, language.train(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees go.

    Null and empty texts fail the base rules; null ids and repeated rows stay as often as they pass; without labels of both
    classes the trees keep all that pass the base rules.
    """
    return quality_rules.keep(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays.

    A null id is the largest; ties of ids go to the smaller text hash; of rows equal in id and text one stays; null and empty
    texts are one group.
    """
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Workers are shared with the stages before, so each remembers fewer chunks than packing alone may.

    Null texts are empty ones, which hold the end mark alone; repeated rows and null ids are packed as often as they come.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), remember=100_000).drop("ids")


STAGES = [("language ID", known_language), ("quality rules", good_quality), ("SimHash near-dedup", without_near_duplicates), ("packing", packed)]
#: No SQL expresses a learned field, trees, components or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote is deleted when the next one has been written; the last result rests on its input alone."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        at = place(spark)
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), at)
        if before:
            remove(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
