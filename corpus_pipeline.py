"""A corpus pipeline of five stages, from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs.
An empty table passes through; rows with a null text go in the first stage, since no language can be told.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import langid, packing, repeats, simhash, suffixes
from loomgraph.llm.common import drop_staged, staged, staged_so_far, table
from loomgraph.llm.queries import third

#: Pooled probability below which no language is believed; four languages at chance have 0.25.
LEAST_SCORE = 0.35


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language claims go."""
    named = langid.classify(docs, langid.learn(docs, third() != 1), prediction="__lg_lang", score="__lg_score")
    return _columns(named.where((F.col("__lg_lang") != langid.UNDETERMINED) & (F.col("__lg_score") >= LEAST_SCORE)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays: the one with the smallest identifier."""
    return simhash.keep_one(docs, simhash.similar(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; a text that loses nothing keeps its lines, one that loses every word goes."""
    cut = repeats.remove_repeats(docs, kept="__lg_kept", changed_only=True)
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("__lg_kept")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(changed, F.length("__lg_kept").cast("long")).otherwise(F.col("n_chars"))}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any benchmark item occurs go."""
    return suffixes.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), least_items=1)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, placed in sequences."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: The stages hash, learn and tokenise in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what each leaves is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        since = staged_so_far()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
            drop_staged(spark, max(0, since - 1) if i else since)  # what the stage read and wrote on its way
    return docs
