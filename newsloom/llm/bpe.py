"""Byte-level BPE encoding and decoding by a sentencepiece model made from a rank file.

The vocabulary is serialised straight into a sentencepiece BPE model: each token's bytes are spelled
with one printable letter a byte, its score is its negative rank, and normalisation is the identity.
The library then joins the pair of best score, leftmost first, which is what the ranks ask for. Text is
cut by the vocabulary's pattern; each pre-token is spelled and encoded; decoding maps ids back to bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; other columns of the input
play no part, whatever their names; repeated rows give repeated results; a text of any length is one row.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from newsloom.llm import vocab
from newsloom.llm.common import bound_batches, kept_in_worker, map_rows

#: Pre-tokens that a worker remembers (when full it forgets all of them), and the longest of them in characters.
MEMO, LONGEST = 300_000, 64


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: a varint, a 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(int(value))


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece i is the token of rank i."""
    by_rank = sorted(ranks.items(), key=lambda item: item[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    # ModelProto: 1 pieces (1 piece, 2 score, 3 type), 2 trainer_spec, 3 normalizer_spec.
    pieces = [_field(1, _field(1, vocab.spelled(token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for token, rank in by_rank]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # TrainerSpec: 3 model_type (2 is BPE), 4 vocab_size, 40 to 43 the ids of unk, bos, eos, pad.
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    # NormalizerSpec: 1 name, 3 add_dummy_prefix, 4 remove_extra_whitespaces, 5 escape_whitespaces.
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


class Codec(dict):
    """Ids of pre-tokens, remembered; a miss goes to the sentencepiece model."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [token for token, _ in sorted(ranks.items(), key=lambda item: item[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.split = vocab.splitter(pattern)

    def __missing__(self, token: str) -> tuple[int, ...]:
        data = token.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(self.model.encode(vocab.spelled(data)))
        if len(token) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec for a rank file."""
    key = f"bpe {hashlib.sha256(data).hexdigest()} {pattern}"
    return kept_in_worker(key, lambda: Codec(vocab.parse_ranks(data), pattern))


def round_trip(docs: DataFrame, rank_path: str, pattern: str, keep_text: bool = False) -> DataFrame:
    """doc_id, ids array<int>, decoded binary and, if asked for, text of every row of docs (doc_id, text), in one narrow stage."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab.read_bytes(rank_path))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(sent.value, pattern)
        ids, decoded = [], []
        for text in batch.column(1):
            got = own.encode(text.as_py())
            ids.append(pa.array(got, pa.int32()))
            decoded.append(own.decode(got))
        offsets = pa.array([0, *_running(map(len, ids))], pa.int32())
        flat = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
        columns = [batch.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array(decoded, pa.binary()), *[batch.column(1)] * keep_text]
        return pa.record_batch(columns, names=["doc_id", "ids", "decoded", *["text"] * keep_text])

    return map_rows(docs.select("doc_id", "text"), "text", "doc_id long, ids array<int>, decoded binary" + ", text string" * keep_text, work)


def _running(sizes) -> list[int]:
    out, total = [], 0
    for n in sizes:
        total += n
        out.append(total)
    return out


def decode_ids(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and decoded binary of rows (doc_id, ids): the inverse mapping alone; null ids decode to null."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocab.read_bytes(rank_path))

    def run(batches):
        for batch in batches:
            own = codec(sent.value, pattern)
            got = [None if ids is None else own.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(got, pa.binary())], names=["doc_id", "decoded"])

    bound_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
