"""The training-data pipeline: quality, near-duplicates, personal data, mixture, packing.

Each stage takes the documents that its predecessor kept, applies one operator of ``textloom.llm`` to
all of them, and returns documents again; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common, mixing, neardup, packing, pii, quality

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Hundredths of similarity from which documents are near-duplicates here; op1 has its own.
NEAR = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score at least 0.5); null and empty texts are scored as empty. An empty
    table gives an empty result."""
    docs = docs.select(*DOCUMENTS)
    model = quality.train(docs, common.read(spark, sf_dir, "labels"))
    return quality.score(docs, model, DOCUMENTS).where("score >= 0.5").select(*DOCUMENTS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.80 or more), the one with the least id. Documents without an
    id are in no group. Rows that repeat an id and its text are one document."""
    docs = docs.select(*DOCUMENTS)
    kept = neardup.near_duplicates(docs, NEAR).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL")).select(*DOCUMENTS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span found replaced by the mark of its kind; n_chars follows the text. Null and empty texts hold no
    spans; repeated rows and null ids are rows like others. An empty table gives an empty result."""
    found = pii.find_pii(docs, ["doc_id", "lang", "source", "n_chars"], redacted=True)
    n_chars = F.coalesce(F.char_length("redacted").cast("long"), F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, three times at most; documents without words are not in it.
    An empty table gives an empty result."""
    docs = docs.select(*DOCUMENTS)
    taken = mixing.copies(docs, mixing.mix_plan(docs)).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; null and empty texts are one token. An empty
    table gives an empty result."""
    return packing.pack(packing.tokenize_pieces(docs))


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", keep_one_of_each),
    ("pii", redact_personal_data),
    ("mixture", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained model, MinHash groups and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole of documents, each written as Parquet and read again."""
    return _run(common.read(spark, sf_dir, "documents"), sf_dir)


@common.with_scratch
def _run(docs: DataFrame, sf_dir: str, *, scratch: common.Scratch) -> DataFrame:
    spark = docs.sparkSession
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
