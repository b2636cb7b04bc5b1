"""From raw documents to packed sequences: five stages, each on all that the one before it kept.

Null doc_ids and texts, empty and very long texts, repeated rows and empty tables go through every stage; further columns
come out as they went in, whatever their names, but for the last stage, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinspot.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from twinspot.llm.common import table, tokenizer_path, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; null and empty texts score lowest and stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document, or an earlier line, has are cut; every row stays, perhaps empty."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest doc_id; texts without words all stay, once for each doc_id."""
    return near_dup.deduplicated(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go; texts without words stay."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"), window=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, with its end id, in pieces of sequences; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, room=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned scores and token ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
