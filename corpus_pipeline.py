"""From raw documents to tokens: each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.bpe_stream import encode_decode
from sextant.llm.common import checkpointed
from sextant.llm.decontaminate import contamination
from sextant.llm.line_dedup import line_dedup
from sextant.llm.quality import quality_scores
from sextant.llm.simhash import one_of_each

#: The columns that each stage but the last returns.
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*[df[c] for c in DOCUMENTS])


# What holds for every stage: columns other than these five are ignored, whatever their names; rows are independent of
# their order and partitions; empty tables give empty tables; a very long text is a row of one task, in memory by itself.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier holds to be bad, or that are null or blank, go. Nulls in other columns are
    values of their own; rows that repeat are judged alike; without labels of both classes only blank texts go."""
    scored = quality_scores(_documents(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(scored.where("keep"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in 10 documents or more go from all of them; the documents stay, n_chars is that of what is left.
    Rows that share a doc_id count as one document, rows without one each. A null text becomes the empty text."""
    kept = line_dedup(_documents(docs), min_docs=10, min_chars=1)
    kept = kept.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")})
    return _documents(kept)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, of the smallest doc_id. Rows that share a doc_id but not the text are
    documents of their own; rows without a doc_id stay only if nothing near to them has one, one of each group."""
    return one_of_each(_documents(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark windows go. Null and empty texts have no words and stay;
    rows that repeat are judged alike."""
    found = contamination(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _documents(found.where(~F.col("contaminated")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of every document. Null and empty texts have no tokens; rows
    that repeat come back as often."""
    return encode_decode(_documents(docs), public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokens),
]

#: A classifier is fitted and fingerprints are compared: SQL can't say it. The stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result cut off before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
