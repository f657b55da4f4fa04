"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, BPE coding.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All stages but the last
return the columns of documents; the last returns the ids of each text and the text decoded from them as digests.

Defined results: a null text scores, compares and codes like an empty one and stays null until the last stage, where it has no
ids; null and empty texts are copies of each other, so one of them stays. Rows that repeat a doc_id are judged each by its own
text; rows that repeat doc_id and text are copies. A null doc_id is a document like any other and comes last among copies. Further
columns, whatever their names and types, are kept until the last stage. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import bpe, decontaminate, nearcopies, pii, toxicity
from voxmill.llm.common import shared_dir, table
from voxmill.llm.queries import TOKENIZER
from voxmill.sources.scratch import delete


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labels of docs that aren't held out, scores 0.7 or more go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (Jaccard similarity of 5-word shingles 0.8 or more) one row stays, that of the least doc_id; nulls come last."""
    return nearcopies.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window (8 words, or a whole shorter item) of any benchmark item occurs go; the others stay whole."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind in brackets; n_chars follows."""
    return pii.mask_personal_data(docs)


def as_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256."""
    coded = bpe.encode_decode(docs.select("doc_id", "text"), TOKENIZER)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("bpe", as_token_ids),
]

#: The trained stages have no SQL form; tests compare run() with the operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages the documents are written as Parquet to the shared folder and read again.

    A stage's table is deleted once the next one's is written; the last of them stays, since the result is lazy.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
            if k:
                delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
