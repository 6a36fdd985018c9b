"""Byte-level BPE, token store and token counts against the libraries themselves."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import bpe, token_count, token_store, vocab

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PIECES = ["'s", "s", "t", "re", "v", " ", "lld", "  ", "\n", "\t", ".", "!?", "12", " é", "ß", "漢字", "\U0001f600", "<|endoftext|>", "AB", "the", "ing", "Ɤ", " x", "aaaa", "²", "\x85"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(1500)]
    return [None, "", "<|endoftext|>", " ".join(made[:300]), "a" * 3000, *made]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, "again", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)  # `ids` clashes with an output


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_round_trip_matches_tiktoken(docs, texts):
    ranks = vocab.parse_ranks(vocab.read_bytes(RANKS))
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.round_trip(docs, RANKS, P.PATTERN).where("doc_id is not null and doc_id <> 3").collect()
    assert len(rows) == len(texts) - 1
    for row in rows:
        text = texts[row.doc_id] or ""
        assert row.ids == reference.encode_ordinary(text) and bytes(row.decoded) == text.encode()


def test_decoding_alone(docs):
    made = bpe.round_trip(docs, RANKS, P.PATTERN)
    again = bpe.decode_ids(made, RANKS, P.PATTERN)
    assert again.exceptAll(made.select("doc_id", "decoded")).count() == 0


def test_model_is_a_sentencepiece_model():
    codec = bpe.codec(vocab.read_bytes(RANKS), P.PATTERN)
    assert codec.model.get_piece_size() == len(codec.ranks) + 1
    assert codec.model.id_to_piece(1000) == vocab.spelled(codec.bytes_of[1000])
    with pytest.raises(ValueError):
        bpe.sentencepiece_model({b"a": 0, b"b": 2})


def test_counts_match_the_library(docs, texts, library, monkeypatch):
    rows = token_count.count_tokens(docs, JSON, P.PATTERN).where("doc_id is not null and doc_id <> 3").collect()
    for row in rows:
        text = texts[row.doc_id] or ""
        assert row.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert row.n_bytes == len(text.encode()) and row.over_limit == (row.n_tokens > 512)


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_pieces_and_chunk_maps_give_the_whole(texts, library, monkeypatch, size):
    own = token_count.Counter(vocab.read_bytes(JSON), P.PATTERN)
    for name in ("PIECE", "CHUNK", "LONGEST"):
        monkeypatch.setattr(token_count, name, size)
    monkeypatch.setattr(token_count, "MAPS", 3)
    for text in texts[2:200]:
        assert own.count(text[:400]) == len(library.encode(text[:400], add_special_tokens=False).ids)


def test_composition_is_associative():
    own = token_count.CountTransducer(vocab.parse_merges(vocab.read_bytes(JSON))[1])
    maps, entered = [], {token_count.START}
    for part in (b"unbeliev", b"ablyonet", b"wothreef", b"ourfives"):
        maps.append(own.chunk_map(part, entered))
        entered = {state for state, _ in maps[-1].values()}
    a, b, c, d = maps
    compose = token_count.compose
    assert compose(compose(a, b), compose(c, d)) == compose(a, compose(compose(b, c), d)) == token_count.scan(maps)[-1]
    assert compose(compose(a, b), c)[token_count.START][1] == own.count("unbelievablyonetwothreef")


def test_long_texts_without_blanks(library):
    rng = random.Random(6)
    own = token_count.Counter(vocab.read_bytes(JSON), P.PATTERN)
    han = "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(60_000))
    for text in (han, "ab" * 50_000, "，".join(han[i : i + 50] for i in range(0, 20_000, 50)), "x1" * 40_000, "don't" * 20_000, "ab" * 40_000 + "<|endoftext|>" + "zz" * 40_000):
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert max(map(len, own)) <= token_count.LONGEST


def test_counts_of_other_tokenizers_and_patterns():
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for own in (token_count.Counter(vocab.read_bytes(path), P.PATTERN), token_count.Counter(vocab.read_bytes(JSON), r"\S+|\s+")):
        assert own.by_library
    assert token_count.Counter(vocab.read_bytes(path), P.PATTERN).count("Hello World, it's 3 pm") == len(library.encode("Hello World, it's 3 pm", add_special_tokens=False).ids)


def test_store_reads_back_what_the_library_gives(spark, docs, texts, library, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs, folder, JSON, P.PATTERN, 2, shard_docs=200)
    rows = token_store.read_store(spark, folder).withColumn("crc", F.crc32("ids")).collect()
    assert len(rows) == docs.count()
    by_start = sorted(rows, key=lambda r: r.start)
    assert by_start[0].doc_id is None and [r.doc_id for r in by_start[1:]] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    place = 0
    for row in by_start:
        assert row.start == place
        place += row.n_tokens
    for row in rows:
        if row.doc_id not in (None, 3):
            ids = [*library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids, 2]
            raw = np.array(ids, "<u4").tobytes()
            assert bytes(row.ids) == raw and row.crc == zlib.crc32(raw) and row.n_tokens == len(ids)


def test_shards_are_plain_seekable_zstandard(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs, folder, JSON, P.PATTERN, 2, shard_docs=100_000)
    path = tmp_path / "store/shards/shard-000000.tzs"
    with path.open("rb") as source:
        data = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read()
    assert len(data) == 4 * token_store.read_store(spark, folder).agg(F.sum("n_tokens")).first()[0]
    few = token_store.read_store(spark, folder, [5, 7]).collect()
    assert sorted(r.doc_id for r in few) == [5, 7]
    raw = bytearray(path.read_bytes())
    raw[40] ^= 1
    path.write_bytes(bytes(raw))
    with pytest.raises(Exception):  # noqa: B017
        token_store.read_store(spark, folder).count()
        token_store.read_store(spark, folder).agg(F.max(F.length("ids"))).collect()


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0
    assert token_count.count_tokens(none, JSON, P.PATTERN).count() == 0
    token_store.write_store(none, f"file://{tmp_path}/s", JSON, P.PATTERN, 2)
    assert token_store.read_store(spark, f"file://{tmp_path}/s").count() == 0


def test_pattern_engines_agree():
    import regex

    full, own, rng = regex.compile(P.PATTERN).findall, vocab.splitter(P.PATTERN), random.Random(9)
    for _ in range(20_000):
        text = "".join(chr(rng.choice([rng.randrange(256), 39, 32, 10, 115, 233])) for _ in range(rng.randrange(10)))
        assert own(text) == full(text)


def test_alike_ranges(library):
    rng = random.Random(2)
    full = vocab.splitter(P.PATTERN)
    for c in [0x557, 0x58D, 0x88E, 0xC5B, 0xCDD, 0x208E, 0x20A0, 0xA7CD, 0xA7F2, 0xAB6B, 0xAB6E, 0x107BA, *(rng.randrange(0x20000) for _ in range(3000))]:
        text = f"a{chr(c)}a {chr(c)}1{chr(c)}\n." if not 0xD800 <= c < 0xE000 else "a"
        if vocab.cuts_alike(text):
            assert [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)] == full(text)


def test_other_tokenizers_go_to_the_library():
    path = P.path("word_bpe_49k.json")
    own, library = token_store.LibraryCodec(vocab.read_bytes(path), P.PATTERN), Tokenizer.from_file(path)
    texts = ["Hello World, it's 3 pm", "", "<|endoftext|> ünï"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_words_are_not_walked_for_each_text():
    class Watched(token_store.LibraryCodec):
        def __iter__(self):
            raise AssertionError("all remembered words were walked")

    own = Watched(vocab.read_bytes(JSON), P.PATTERN)
    assert own.encode(["two words", ""]) == own.encode(["two words", ""])


@pytest.mark.parametrize("memo", [0, 1_000_000])
def test_texts_looked_up_in_small_steps(library, monkeypatch, memo):
    monkeypatch.setattr(token_store, "LOOKED_UP", 40)
    monkeypatch.setattr(token_store, "MEMO", memo)
    own = token_store.LibraryCodec(vocab.read_bytes(JSON), P.PATTERN)
    texts = ["", "a", "  it's (3) \u00a0 x\t y\n\n \n z ", " 12 34 !? ...", "Größe " + "w" * 90, "", "你好 <|endoftext|> a", "\u1c89 b", " \r\n", "x\u2028 y"] * 3
    texts += [f"{t} {i}" for i, t in enumerate(texts)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
