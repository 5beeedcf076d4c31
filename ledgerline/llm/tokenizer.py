"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The text is taken with a space before it. As no piece has a marker after another character, the best
segmentation of a text is that of its chunks (spaces and the characters after them, line breaks apart), so
each distinct chunk is segmented once per worker and looked up after that. A character that no piece covers
is written as its UTF-8 bytes' pieces, also the marker character itself, so decoding gives the text back.

Defined results: null text: null ids; empty text: no ids. Repeated rows give equal ids. Texts of any length
are encoded whole. Other columns of the input are not touched; ``ids`` and the other results are new columns.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .lattice import VECTOR_BYTES, Vocabulary, lattice, load_vocabulary, viterbi, word_viterbi

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CACHE_CHUNKS = 400_000

_CHUNKS = re.compile(rb"\n| +[^ \n]*|[^ \n]+")
_CHUNKS_NEWLINE = re.compile(rb" +[^ ]*|[^ ]+")


def runs_of_bytes(texts: list[bytes | None], most: int = 2_000_000):
    """Bounds of runs of texts of about ``most`` bytes, or of a single longer one."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text or b"") > most:
            yield at, k
            at, size = k, 0
        size += len(text or b"")
    if at < len(texts):
        yield at, len(texts)


class Codec:
    """Encoder and decoder of one worker, with the segmentations of chunks that it has met."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.known = vocab, {}
        self.scores = np.append(vocab.scores, vocab.fallback_score)
        self.chunks = (_CHUNKS_NEWLINE if vocab.has_newline else _CHUNKS).findall
        self.lengths = np.array([len(p) for p in vocab.pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(vocab.pieces), np.uint8)
        self.is_byte = np.zeros(vocab.size, bool)
        self.is_byte[vocab.byte_ids[vocab.byte_ids >= 0]] = True

    def _ids(self, word: bytes, edges) -> bytes:
        out: list[int] = []
        for s, e, i in edges:
            if i < self.vocab.size:
                out.append(i)
            else:
                out.extend(self.vocab.byte_ids[list(word[s:e])])
        return np.array(out, np.int32).tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Segments distinct words not met before."""
        short = sorted((w for w in words if len(w) <= VECTOR_BYTES), key=len)
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            lens, steps = lattice(self.vocab, part)
            _, start, ids = viterbi(lens, steps, self.scores)
            for row, (word, first, piece) in enumerate(zip(part, start, ids, strict=True)):
                edges, end = [], int(lens[row])
                while end:
                    edges.append((int(first[end]), end, int(piece[end])))
                    end = int(first[end])
                self.known[word] = self._ids(word, reversed(edges))
        for word in words:
            if len(word) > VECTOR_BYTES:
                self.known[word] = self._ids(word, word_viterbi(self.vocab, word, self.scores))

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray | None]:
        """Ids of each text (UTF-8)."""
        if len(self.known) > CACHE_CHUNKS:
            self.known = {}
        out: list[np.ndarray | None] = []
        for at, end in runs_of_bytes(texts):
            chunks = [None if t is None else self.chunks(b" " + t) if t else [] for t in texts[at:end]]
            new = {c for x in chunks if x for c in x if c not in self.known}
            if new:
                self.learn(sorted(new))
            out += [None if x is None else np.frombuffer(b"".join(map(self.known.__getitem__, x)), np.int32) for x in chunks]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; byte pieces give their bytes, the first space is taken off."""
        lens = self.lengths[ids]
        if not len(ids):
            return b""
        at = np.repeat(self.starts[ids] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        text = self.letters[at].tobytes()
        return text[1:] if text[:1] == b" " and not self.is_byte[ids[0]] else text


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with the pieces' ids of ``text`` as array<int> ``ids`` (which replaces a column of that name)."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    docs = docs.drop(ids) if ids in docs.columns and ids != text else docs
    spec = docs.sparkSession.createDataFrame([], docs.schema).selectExpr("*", f"cast(null as array<int>) as `{ids}`").schema

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            found = codec.encode(batch.column(text).cast(pa.binary()).to_pylist())
            yield _with_column(batch, ids, _lists(found))

    return docs.mapInArrow(run, spec)


def decode(rows: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with the text of their ids; null for null. Bytes that are no UTF-8 become U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    rows = rows.drop(text)
    spec = rows.sparkSession.createDataFrame([], rows.schema).selectExpr("*", f"cast(null as string) as `{text}`").schema

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int32)).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield _with_column(batch, text, pa.array(texts, pa.string()))

    return rows.mapInArrow(run, spec)


def _lists(found: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if x is None else len(x) for x in found], np.int64)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    values = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([x is None for x in found]))


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again.

    doc_id, ids, n_tokens, n_byte_tokens, ids_sha256 (of the little-endian 32-bit ids), decoded_sha256 (of
    the decoded UTF-8) and round_trip (the decoded text is the text); nulls for null text.
    """
    shared = spark.sparkContext.broadcast(load_vocabulary(VOCABULARY))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            encoded = codec.encode(texts)
            out = {k: [] for k in ("n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip")}
            for text, ids in zip(texts, encoded, strict=True):
                if ids is None:
                    row = [None] * 5
                else:
                    back = codec.decode(ids)
                    row = [len(ids), int(codec.is_byte[ids].sum()), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text]
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(encoded), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=["doc_id", "ids", *out])

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")
