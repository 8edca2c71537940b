"""The corpus pipeline: five of the operators of citelake.llm in a row over the table documents.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. A stage works on
all rows that the one before it kept; run() writes each stage's result into the shared folder and reads it again; what only earlier stages have read is deleted.
Nulls, empty texts, repeated rows and extra columns are treated as the operators' own descriptions say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citelake.llm.bpe_chunks import encode_documents
from citelake.llm.decontamination import contaminated, contamination
from citelake.llm.line_dedup import dedup_lines
from citelake.llm.near_dedup import drop_near_duplicates
from citelake.llm.simhash import linked_texts
from citelake.llm.toxicity import TOXIC, toxicity, train
from citelake.sources.shared import clean_up, durable, written

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of TOXIC or more go. The model is learned from labels of documents that are here."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).filter(F.col("score") < TOXIC).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on a large share of their source's pages go; n_chars follows the text. All documents stay."""
    out = dedup_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*(changed if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id. Texts are linked by their fingerprints, as op8_simhash does; pairs with
    similar sets of shingles that fingerprints don't bring together are linked, too."""
    return drop_near_duplicates(docs, groups=linked_texts(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a twentieth or more of the words stand in windows of benchmark items."""
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.filter(~contaminated(F.col("n_hit"), F.col("n_words"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): the documents' token ids, with every decoded text's SHA-256."""
    import public_tokenizers

    out = encode_documents(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: SQL expresses neither the toxicity model nor the encoding; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), written(spark)
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = durable(docs)
            clean_up(spark, keep=[*others, docs._citelake_path])
    return docs
