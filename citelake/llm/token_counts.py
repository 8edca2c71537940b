"""Token counts: the pieces of each distinct pre-token are counted once and summed over every document's pre-tokens.

Three jobs: (1) count all pre-tokens of the corpus; (2) count the pieces of each distinct pre-token, and write
that table; (3) sum pieces times frequency per document. No job makes a document's ids. Memory: a task holds at most
terms.FLUSH distinct pre-tokens and a bounded broadcast table; the corpus vocabulary itself is only ever shuffled.

Defined results: null and empty texts have 0 tokens and 0 bytes; repeated rows are counted row by row; null ids stay
null; columns of `docs` other than doc_id and text are not read; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import durable
from .pretokens import Pretokenizer, read_spec
from .terms import HEAD, corpus_terms, document_sums


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of `docs`."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def cutter() -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
        own = Pretokenizer(spec.value)
        return own.prepare, own.pretokens

    def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Pretokenizer(spec.value).tokenizer
        for batch in batches:
            encoded = tokenizer.encode_batch(batch.column("term").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("n"), pa.array([len(e.ids) for e in encoded], pa.int64())], names=["term", "n", "pieces"])

    values = durable(corpus_terms(docs, cutter).mapInArrow(count_pieces, "term string, n long, pieces long"))
    source = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = document_sums(source, ["doc_id", "n_bytes"], values, ["pieces"], cutter, head)
    return counted.select("doc_id", "n_bytes", F.col("pieces").alias("n_tokens"), (F.col("pieces") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
