"""BPE encoding and decoding with content-defined chunks that documents share.

Texts are cut by a rolling hash over the last WINDOW characters, so equal passages are cut into equal chunks wherever
they stand. Jobs: (1) count every chunk of the corpus by its 128-bit hash, and note for each a text that holds it; (2) the chunks that recur,
ranked by the characters that reuse saves and at most `dictionary` of them, are fetched from those texts alone and encoded once; (3) every
document is assembled: a chunk of the dictionary brings its ids, everything else is encoded where it stands, and each join is
repaired. Of the text, nothing is shuffled but the dictionary's own chunks; of other chunks only hashes are. The dictionary's size is
the same for every corpus, and it is what the driver receives (some 8 MB); README says what share of the recurring text it serves.

Repair of a join: a dictionary chunk brings the ids of the stretch between its first and its last white space, for no
pre-token spans white space. What lies left of it (the rest of the chunk before and the chunk's own ragged head) is
encoded again together with the chunk's first run of characters, and the ids of that run must come out as the dictionary has
them; if not, the window grows by the whole chunk, whose ids are then made anew.

Decoding joins the pieces of the ids as the library's decode(ids, skip_special_tokens=False) does for a file without a decoder:
with one blank between pieces.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows give repeated results;
other columns of `docs` are passed through, a column named like an added one (ids, decoded) is replaced."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import pieces, plain_names
from .pretokens import Pretokenizer, read_spec

#: Of a chunk: window of the rolling hash, mean length (a power of two), least and greatest length in characters.
WINDOW, MEAN, LEAST, MOST = 16, 256, 64, 2048
#: The dictionary's bound in chunks; with MOST it bounds the broadcast at 32 MB, and at MEAN it takes some 8 MB.
DICTIONARY = 16_384
#: A task hands on its chunk counts when it holds so many.
FLUSH = 300_000
_SPACE = regex.compile(r"[ \n\t\r]")
_GEAR = np.random.default_rng(7).integers(0, 2**64, 4096, dtype=np.uint64)


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text, its length included."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    gear = _GEAR[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 4095]
    # A character's weight doubles with each step back, so that the top bits hold the last WINDOW characters.
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        rolled[k:] += gear[: n - k] << np.uint64(k * 4)
    marks = np.flatnonzero((rolled >> np.uint64(60 - MEAN.bit_length() + 1)) & np.uint64(MEAN - 1) == 0) + 1
    out, start = [], 0
    for m in [*marks.tolist(), n]:
        while m - start > MOST:
            start += MOST
            out.append(start)
        if m - start >= LEAST or m == n and m > start:
            out.append(m)
            start = m
    return out


def chunks(text: str) -> list[tuple[int, int, bytes]]:
    """(start, end, hash) of each chunk."""
    out, start = [], 0
    for end in cuts(text):
        out.append((start, end, xxhash.xxh3_128_digest(text[start:end].encode("utf-8", "surrogatepass"))))
        start = end
    return out


def owner(text: str | None) -> int:
    """The number of a text, the same wherever it stands."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


class Encoder:
    """Encodes texts with a dictionary from chunk hashes to the ids of the chunk's inner stretch."""

    def __init__(self, spec: str, dictionary: dict[bytes, tuple[int, int, int, bytes]]) -> None:
        self.own = Pretokenizer(spec)
        self.dictionary = dictionary
        tokenizer = self.own.tokenizer
        self.pieces = np.array([tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())], dtype=object)

    def inner(self, chunk: str) -> tuple[int, int, int, bytes] | None:
        """(start, end, number of ids of the first run, all ids) of the stretch between white space; None if there is none."""
        found = [m.start() for m in _SPACE.finditer(chunk)]
        if len(found) < 2:
            return None
        a, b = found[0], found[-1]
        run = next((x for x in found[1:] if x > a + 1), b)
        return a, b, len(self.own.encode(chunk[a:run])), self.own.encode(chunk[a:b]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        out: list[np.ndarray] = []
        left = 0  # all before it is encoded
        for start, end, key in chunks(text) if self.dictionary else ():
            if (known := self.dictionary.get(key)) is None:
                continue
            a, b, first, ids = known
            ids = np.frombuffer(ids, dtype=np.int32)
            run = a + 1
            while run < b and (text[start + run] not in " \n\t\r" or run == a + 1):
                run += 1
            window = self.own.encode(text[left : start + run])
            if first and not np.array_equal(window[-first:], ids[:first]):  # no agreement: the window takes the whole chunk
                out.append(self.own.encode(text[left : start + b]))
            else:
                out += [window[: len(window) - first], ids]
            left = start + b
        return np.concatenate([*out, self.own.encode(text[left:])])

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.pieces[ids].tolist())


def encode_documents(docs: DataFrame, tokenizer_path: str, dictionary: int = DICTIONARY) -> DataFrame:
    """The rows of `docs` with the added columns ids (array of int) and decoded (string)."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        first: dict[bytes, tuple[int, int]] = {}

        def out() -> pa.RecordBatch:
            chars, owners = zip(*first.values(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64()), pa.array(chars, pa.int32()), pa.array(owners, pa.int64())], names=["chunk", "n", "chars", "owner"])

        for batch in batches:
            for part in pieces(batch, "text"):
                for text in part.column("text").to_pylist():
                    own = owner(text)
                    for start, end, key in chunks(text or ""):
                        held[key] += 1
                        if key not in first:
                            first[key] = end - start, own
                if len(held) > FLUSH:
                    yield out()
                    held.clear(), first.clear()
        if held:
            yield out()

    counted = docs.select("text").mapInArrow(count, "chunk binary, n long, chars int, owner long").groupBy("chunk").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"), F.min("owner").alias("owner"))
    best = counted.filter("n > 1").orderBy(F.desc(F.expr("(n - 1) * chars")), "chunk").limit(dictionary)
    wanted = spark.sparkContext.broadcast({bytes(r[0]): r[1] for r in best.select("chunk", "owner").collect()})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing, owners = set(wanted.value), set(wanted.value.values())
        for batch in batches:
            for part in pieces(batch, "text"):
                found = {}
                for text in part.column("text").to_pylist():
                    for start, end, key in chunks(text or "") if owner(text) in owners else ():
                        if key in missing:
                            missing.remove(key)
                            found[key] = text[start:end]
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.string())], names=["chunk", "text"])

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec.value, {})
        for batch in batches:
            rows = [(k, *v) for k, x in zip(batch.column("chunk").to_pylist(), batch.column("text").to_pylist(), strict=True) if (v := encoder.inner(x))]
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["chunk", "a", "b", "first", "ids"])

    known: dict[bytes, tuple[int, int, int, bytes]] = {}
    if wanted.value:
        texts = docs.select("text").mapInArrow(fetch, "chunk binary, text string").groupBy("chunk").agg(F.min("text").alias("text"))
        rows = texts.mapInArrow(encode_chunks, "chunk binary, a int, b int, first int, ids binary").collect()
        known = {bytes(r[0]): (r[1], r[2], r[3], bytes(r[4])) for r in rows}
    held = spark.sparkContext.broadcast(known)
    source, keep, back = plain_names(docs, ["ids", "decoded"])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.schema), "ids array<int>", "decoded string"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec.value, held.value)
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                ids = [encoder.encode(text or "") for text in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                added = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array([encoder.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*keep, "ids", "decoded"])

    return back(source.mapInArrow(assemble, schema))


def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
