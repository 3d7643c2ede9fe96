"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, on all rows that
the stage before kept:

1. quality classifier: documents whose ordinal grade says unusable go;
2. toxicity: documents scored 0.7 or more go;
3. n-gram Jaccard join: of documents linked at 0.8 over five-word shingles, the smallest id stays;
4. substring dedup: words in a 35-word window that also starts elsewhere are cut out of the text;
5. best-fit packing: the tokens of all documents, packed into sequences of 4096.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm import grading, packing, repeats, shingle_join, toxicity
from candlewright.llm.common import table, written
from candlewright.llm.queries import tokenizer_file

#: SQL expresses neither the trained models nor the tokenizer; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = grading.train(docs, table(spark, sf_dir, "labels"))
    return grading.grade(docs, model).where("keep").select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = shingle_join.join_documents(docs, k=5, threshold=(80, 100))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__first")).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("__first")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(docs, window=35, keep_text=True)
    counted = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(counted)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
