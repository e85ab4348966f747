"""A training-data pipeline over `documents`; each stage works on all that the one before kept.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keelsort.llm import chosen, common, cover, lsm, pack, toxic
from keelsort.llm.queries import table, word_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxic.without_toxic(docs, toxic.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest doc_id, of each group of equal texts."""
    return lsm.without_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles, similarity 0.8 or more."""
    return chosen.without_near_copies(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word passages that a document of smaller doc_id has are cut; n_chars follows."""
    plain, back = common.plain_names(docs)
    at = {name: f"c{docs.columns.index(name)}" for name in ("doc_id", "text", "n_chars")}
    text = F.col(at["text"])
    cut = cover.without_repeats(plain.withColumn("was", F.xxhash64(text)), at["doc_id"], at["text"])
    changed = ~F.xxhash64(text).eqNullSafe(F.col("was"))
    return back(cut.withColumn(at["n_chars"], F.when(changed, F.char_length(text).cast("long")).otherwise(F.col(at["n_chars"]))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return pack.pack_documents(docs, word_bpe(), 4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]

#: Learnt scores and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
