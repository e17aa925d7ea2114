r"""From raw documents to token ids: five stages, each over all that the one before kept.

1. toxicity: documents scored ``toxicity.THRESHOLD`` or more go; the model learns
   from every labelled document.
2. line dedup: lines of at least 20 code points that three documents share stay
   in the one with the largest doc_id only; n_chars follows the text.
3. MinHash near-dedup: one document of each group stays (five-word shingles,
   Jaccard similarity of 0.8 or more).
4. mixing: each source gives its target's words; a document comes once an epoch,
   and the one in which a budget ends is cut after the last word that fits.
   Documents of which no word is taken go.
5. SentencePiece: ids of each row, and whether they decode to the text exactly.

``run`` applies the stages to ``documents``, each written to the folder that
``spark.checkpoint.dir`` names and read back. Rows with null ids or texts, empty
tables and further columns pass as the stages' modules say. SQL can express
neither a trained model nor the encoding, so ``ORACLE_SQL`` is None and the tests
hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import line_dedup, mixing, near_dedup, sentencepiece_viterbi, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, shared.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)("text") < toxicity.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_lines, n_dropped = shared.unused(docs, "lines", "dropped")
    cleaned = line_dedup.without_lines(docs, n_lines=n_lines, n_dropped=n_dropped)
    length = F.when(F.col(n_dropped) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length.cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_documents(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = shared.staged(stage(spark, docs, sf_dir), name)
    return docs


ORACLE_SQL = None
