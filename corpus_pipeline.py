"""The corpus pipeline: from documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.jaccard_join import jaccard_components
from tallyframe.llm.mixing import emit, mix_sources
from tallyframe.llm.packing import pack
from tallyframe.llm.quality import quality_rules
from tallyframe.llm.queries import table, tokenizer_path
from tallyframe.llm.substring_dedup import substring_dedup
from tallyframe.session import cut_lineage

#: The stages hold counts, a language model and connected components; SQL can't express them.
ORACLE_SQL = None


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _columns(quality_rules(docs).filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays, once.

    Documents without an id are kept. Only texts whose id occurs again are shuffled to find the
    one that stays.
    """
    found = jaccard_components(docs.select("doc_id", "text"))
    losers = found.filter("component_id < doc_id").select("doc_id").distinct()
    left = docs.join(cut_lineage(losers, "losers"), "doc_id", "left_anti")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    repeated = cut_lineage(repeated.select("doc_id"), "repeated")
    again = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return _columns(left.join(repeated, "doc_id", "left_anti").unionByName(again), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id holds; emptied documents go."""
    cut = substring_dedup(docs)
    changed = F.col("n_removed") > 0
    whole = cut.filter("n_removed = 0 or n_removed < n_words").withColumn("text", F.col("kept_text"))
    return _columns(
        whole.withColumn(
            "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        ),
        docs,
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return _columns(emit(mix_sources(docs)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all drawn documents, packed into sequences."""
    return pack(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mix_sources", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
