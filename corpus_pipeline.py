"""From raw documents to packed training sequences: five stages, each one operator of tidemill.llm.

Every stage works on all that its predecessor kept, which is written as Parquet in between.  All but
the last return the columns of documents.

Defined results of every stage: whole texts count, however long; ties are settled by the operators' own
rules; extra columns of any name come through unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.bwt_dedup import suffix_dedup
from tidemill.llm.cells import discard, lean, save
from tidemill.llm.config_packing import pack
from tidemill.llm.quality_net import quality_net
from tidemill.llm.simhash_mih import similar_groups
from tidemill.llm.toxicity import toxicity

#: Bytes of a passage that the suffix stage removes when it repeats; some 35 words.
PASSAGE_BYTES = 200


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _as_documents(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, from struct ``row`` and a text."""
    return done.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose likelihood of severity 1 or more stays under a half.  A null or empty text is clean; repeated rows stay."""
    return _as_documents(toxicity(docs, _labels(spark, sf_dir)).where(~F.col("toxic")), docs)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network scores at a half or more.  A null text scores as an empty one; repeated rows share a score."""
    return _as_documents(quality_net(docs, _labels(spark, sf_dir)).where("score >= 0.5"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles agree to 0.8 or more: the longest, then the least row hash.

    Null and wordless texts are one group; of rows equal in all columns one stays.
    """
    return similar_groups(docs, size=5, similarity=0.8).where("first").select("row.*")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur twice or more; a character that is cut in part goes, and so does a document left without words.

    A null text counts as empty and stays, as "", since nothing is cut from it; a repeated row of
    PASSAGE_BYTES bytes or more repeats wholly and goes.
    """
    done = suffix_dedup(docs, min_bytes=PASSAGE_BYTES, decoded=True)
    kept = _as_documents(done.where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'"), docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else kept


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place in it.  A null or empty text is one piece with the end id; repeated rows are packed each."""
    done = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return done.select(F.col("row.doc_id").alias("doc_id"), "piece", "start", "length", "ids", "sequence_id", "offset")


def _lean(stage):
    return lambda spark, docs, sf_dir: stage(lean(spark), docs, sf_dir)


STAGES = [
    ("toxicity", _lean(reject_toxic)),
    ("quality classifier", _lean(reject_poor)),
    ("SimHash near-dedup", _lean(drop_near_copies)),
    ("suffix-array dedup", _lean(cut_passages)),
    ("best-fit packing", _lean(pack_sequences)),
]

#: The models, the near-duplicate search and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *filters, (_, last) = STAGES
    read = None
    for number, (_, stage) in enumerate(filters):
        docs = save(stage(spark, docs, sf_dir), f"stage-{number}")
        if read:
            discard(spark, read)
        read = docs.saved_at
    return last(spark, docs, sf_dir)
