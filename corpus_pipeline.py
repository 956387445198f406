"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``.

1. quality classifier: documents it rejects go;
2. n-gram Jaccard join (five words, similarity 0.8): one document of each group of similar ones stays;
3. secret scans: found secrets are replaced in the text, and ``n_chars`` follows;
4. mixing: documents are drawn to the target weights of source, language and topic;
5. best-fit packing: the rest becomes sequences of at most 2048 tokens.

Defined results: with no labels nothing is rejected; a null or empty text is scored by its form, is similar to nothing, holds
no secret, has no tokens for mixing and becomes a sequence piece of one end token where it is drawn; rows with a null id take
part in every stage and are drawn together by mixing; of rows that repeat each other one stays; of rows that share an id,
those of different texts all stay; very long texts are read whole in every stage; an empty table gives an empty result; extra
columns of ``documents`` pass through all stages but the last (one named ``_expected`` or ``_tail`` is lost in the first).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frontwave.llm import jaccard_join, mixing, packing, quality, secret_scan
from frontwave.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; a null text stays null."""
    got = secret_scan.scan(docs, spans="_spans", redact=True)
    changed = F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return got.withColumn("n_chars", changed).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality.select_documents),
    ("n-gram Jaccard join", jaccard_join.one_of_each),
    ("secret scans", redact_secrets),
    ("mixing sources", mixing.sample_documents),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the classifier's model nor the tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
