"""A corpus pipeline of five stages, each an operator of quillgraph.llm; each takes what its predecessor kept.

Documents that the quality classifier rejects go. Of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more) the
smallest id stays. Passages of 200 bytes and more that occur anywhere else are cut from their texts. Sources are mixed to target
weights by whole documents, so a document may come twice. What is left is packed into sequences, a row for each piece.

Every stage takes any rows: null and empty texts are scored as texts without words, link with nothing, lose nothing, and aren't mixed in,
having no words; very long texts are worked on whole. Rows without an id pass the second and third stage as they are. Of rows of one id
the second stage keeps one. A null source is a source of its own. Repeated texts of other ids are near-duplicates, and the smallest id stays;
ties of any order go to the smaller id. Other columns, whatever their names, pass through all stages but the last. An empty table gives
none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.jaccard import Similar, keep_first
from quillgraph.llm.mixing import Mix, mixed_texts
from quillgraph.llm.packing import pack_documents, tokenizer_file
from quillgraph.llm.quality import keep_good
from quillgraph.llm.suffix_dedup import Repeats, without_repeats

SIMILAR = Similar(width=5, percent=80)
REPEATS = Repeats(length=200, k=80)
MIX = Mix(block_words=1 << 40)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those that the quality model, fitted on labelled rows outside its held-out fold, scores at the cut or above."""
    return keep_good(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates, and rows without an id."""
    return keep_first(spark, docs, SIMILAR)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that occur anywhere else; n_chars follows the text."""
    return without_repeats(spark, docs, REPEATS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row once for each epoch in which the mix takes it, dealt to shards and shuffled in each."""
    return mixed_texts(spark, docs, MIX)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    return pack_documents(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("mixing", mixing),
    ("packing", packing),
]
#: Models, tokens and shuffles aren't SQL's; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.common import Scratch

    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs, name)
    return docs
