"""Packing, hard negatives and token alignment against plain versions on small tables."""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from newsloom.llm import hard_negatives, packing, token_alignment, vocab

SF = "/root/testdata/sf0.001"
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "\n", "a", "  two  words \n\n and  more", "½ 你好 ﬁ \t x", "<|endoftext|> a <s> </s> <0x41>", "a▁b", "x\x00y", "The same text again.", "The same text again.", "word " * 700, "é" * 3000, "👩‍👩‍👧 " * 40]


def texts_table(spark, texts=TEXTS, extra=False):
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.withColumns({"n": F.lit(1), "id": F.lit("x"), "size": F.lit(2), "chunk": F.lit(3)}) if extra else made


# Packing


def best_fit(lengths, capacity):
    gaps, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        bins += gap == capacity and i == len(gaps)
        if gap > n:
            bisect.insort(gaps, gap - n)
    return bins


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_of_whole_texts(spark):
    rows = packing.pack_documents(texts_table(spark, extra=True), JSON, public_tokenizers.PATTERN, 0, 100).collect()
    library = Tokenizer.from_file(JSON)
    held = defaultdict(list)
    for r in rows:
        held[r["doc_id"]].append(r)
    assert len(held) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(held[i or None], key=lambda r: r["piece"])
        cuts = [0, *range((len(ids) - 1) % 100 + 1, len(ids) + 1, 100)]
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(k, a, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    check_sequences(rows, 100)


LENGTHS = {
    "edges": [1] * 300 + [2048] * 7 + [1024] * 41 + [600] * 100, "nothing": [],
    "third one length": [700] * 300 + np.random.default_rng(1).integers(1, 2049, 600).tolist(),
    "many small": np.random.default_rng(2).integers(1, 60, 2500).tolist() + [1500] * 40,
}


@pytest.mark.parametrize("name", LENGTHS)
def test_about_as_few_sequences_as_best_fit_decreasing(spark, name):
    lengths = LENGTHS[name]
    pieces = spark.createDataFrame([(i * 3, int(n)) for i, n in enumerate(lengths)], "n long, length int")
    rows = [r.asDict() | {"length": lengths[r["n"] // 3]} for r in packing.pack(pieces, 2048).collect()]
    assert sorted(r["n"] // 3 for r in rows) == list(range(len(lengths)))
    used = check_sequences(rows, 2048)
    assert used <= best_fit(lengths, 2048) * 1.01 + 1


@pytest.mark.parametrize("name", LENGTHS)
def test_many_ranges_pack_as_well_as_one(spark, name, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 50)
    test_about_as_few_sequences_as_best_fit_decreasing(spark, name)


def test_few_pieces_make_few_ranges(spark, monkeypatch):
    seen, across = [], packing.across
    monkeypatch.setattr(packing, "across", lambda ranges: seen.append(len(ranges)) or across(ranges))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        test_about_as_few_sequences_as_best_fit_decreasing(spark, "third one length")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert seen and max(seen) == 1


def test_runs_pair_each_row_once():
    ranges = [(0, 0, 0, 3, 900), (1, 5, 400, 0, 0), (2, 0, 0, 2, 300), (3, 7, 100, 1, 90), (4, 9, 10, 0, 0)]
    runs = packing.across(ranges)
    taken = defaultdict(list)
    for r in runs:
        taken[r.part, r.kind] += range(r.first, r.stop)
    assert all(len(v) == len(set(v)) for v in taken.values())
    for piece, gap in zip(runs[::2], runs[1::2], strict=True):
        assert gap.part < piece.part and piece.match == gap.match
        assert piece.each * next(x[2] for x in ranges if x[0] == piece.part) <= next(x[4] for x in ranges if x[0] == gap.part)
        assert -(-(piece.stop - piece.first) // piece.each) == gap.stop - gap.first
    assert taken[1, packing.PIECE] == [0, 1, 2, 3, 4] and taken[3, packing.PIECE] == [0, 1, 2, 3, 4, 5]


def test_registered_packing(spark):
    rows = entry.queries()["op11_best_fit_packing"](spark, SF).collect()
    assert len({r["doc_id"] for r in rows}) == 200
    assert check_sequences(rows, 2048) <= best_fit([r["length"] for r in rows], 2048) + 1


# Hard negatives


def mined(rows, anchors, k=5):
    """(anchor, positive, rank, negative, scores) over rows (id, label, vector), each as often as it is there."""
    sound = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) and np.isfinite(256 * float(x)) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, label, v in {(i, y, tuple(q)) for i, y, q in sound if anchors(i)}:
        scored = sorted((-dot(v, q), i, y) for i, y, q in sound if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fits = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, rank + 1, n, -s, -t) for rank, (t, n, _) in enumerate(fits)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def check_mining(spark, rows, **more):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"n": F.lit(1), "q": F.lit("x"), "stripe": F.lit(9), "score": F.lit(0)})
    got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, **more)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_mining_clustered_and_spread_vectors(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, int(rng.integers(4)), (rng.uniform(0.2, 3) * (centres[i % 6] + spread * rng.normal(size=12))).tolist()) for i in range(400)]
    check_mining(spark, rows, stripe_rows=50)


def test_mining_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(i, i % 2, [1.0, 0.5, 0.0, 0.0]) for i in range(100, 220)]  # one vector, many rows
    rows += [(5, 1, [1.0] * 4), (5, 1, [1.0] * 4), (10, 1, rows[10][2]), (110, 0, [1.0, 0.5, 0.0, 0.0])]  # repeated rows, an anchor too
    rows += [(300, None, [1.0] * 4), (310, 1, None), (None, 1, [1.0] * 4), (320, 1, [1.0, None]), (330, 1, [float("nan")]), (340, 1, [float("inf")]), (350, 1, [1e308])]
    rows += [(360, 1, []), (370, 2, [0.0] * 4), (380, 1, [2.0, 1.0]), (390, 0, [-1.0, -0.5])]
    check_mining(spark, rows, stripe_rows=20)


def test_mining_large_components_is_exact(spark):
    rng = np.random.default_rng(7)
    check_mining(spark, [(i, i % 2, (rng.normal(size=3) * 2e6).round(3).tolist()) for i in range(60)])


@pytest.mark.parametrize("rows", [[], [(0, 1, [1.0])], [(0, None, [1.0])], [(0, 1, []), (1, 1, []), (2, 0, [])]])
def test_mining_few_rows(spark, rows):
    check_mining(spark, rows)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(300, 6)) * rng.uniform(0, 9, size=(300, 1)))
    x[5], x[6] = x[4], -x[4]
    references = hard_negatives.choose_references(x, 4)
    angles, norms = hard_negatives._angles(hard_negatives._directions(x), references), hard_negatives._norms(x)
    least, greatest = hard_negatives.score_bounds(angles[:40], norms[:40], angles, angles, norms, norms)
    scores = x[:40] @ x.T
    assert (least <= scores).all() and (scores <= greatest).all()
    groups = np.array_split(np.argsort(angles[:, 0]), 9)
    low, high = (np.array([f(angles[g], axis=0) for g in groups]) for f in (np.min, np.max))
    least, greatest = hard_negatives.score_bounds(angles[:40], norms[:40], low, high, np.array([norms[g].min() for g in groups]), np.array([norms[g].max() for g in groups]))
    for k, g in enumerate(groups):
        assert (least[:, k, None] <= scores[:, g]).all() and (scores[:, g] <= greatest[:, k, None]).all()


def test_clusters_are_ruled_out_by_their_angles():
    rng = np.random.default_rng(9)
    x = np.concatenate([c + 0.02 * rng.normal(size=(50, 16)) for c in np.linalg.qr(rng.normal(size=(16, 16)))[0][:8]]) * 256
    angles, norms = hard_negatives._angles(hard_negatives._directions(x), hard_negatives.choose_references(x, 8)), hard_negatives._norms(x)
    _, greatest = hard_negatives.score_bounds(angles, norms, angles, angles, norms, norms)
    assert ((greatest >= 0.8 * 256 * 256).sum(axis=1) <= 50).all()


# Alignment


@pytest.mark.parametrize("work", [1, 2, 3, 5, 1000])
def test_pieces_of_a_merge_agree_with_the_whole(work):
    rng = np.random.default_rng(10)
    for _ in range(150):
        last = int(rng.integers(1, 50))
        a, b = (np.union1d(rng.integers(1, last + 1, rng.integers(0, last + 1)), [last]) for _ in range(2))
        ends = np.union1d(a, b)
        got = token_alignment.overlaps(a, b, work)
        assert got[0].tolist() == [int((a < e).sum()) for e in ends] and got[1].tolist() == [int((b < e).sum()) for e in ends]
        assert got[2].tolist() == [e in a and e in b for e in ends]
        cut_a, cut_b = token_alignment.diagonals(a, b, work)
        assert set(np.diff(cut_a + cut_b)[:-1]) <= {work} and (np.diff(cut_a) >= 0).all() and (np.diff(cut_b) >= 0).all()


def test_no_ends_give_no_pieces():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in token_alignment.overlaps(none, none)] == [0, 0, 0]


def aligned(texts):
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    byte_of = {letter: byte for byte, letter in vocab.byte_letters().items()}
    names = {i: t for t, i in a.get_vocab().items()}
    bytes_a = lambda i: bytes(byte_of[c] for c in names[i])
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, links = [], []
    for t in texts:
        whole = f" {t}".encode()
        ids = [a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)] if t else [[], []]
        parts = [[f(i) for i in own] for f, own in zip((bytes_a, bytes_b), ids, strict=True)]
        if not t or any(b"".join(p) != whole for p in parts):
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        common = sorted(set(ends[0]) & set(ends[1]))
        said, at = [], [0, 0]
        for c in common:
            stop = [e.index(c) + 1 for e in ends]
            said.append("|".join(",".join(map(str, ids[k][at[k] : stop[k]])) for k in (0, 1)))
            at = stop
        own = []
        for i, x in enumerate(ends[0]):
            first = x - len(parts[0][i])
            own += [(ids[0][i], ids[1][j]) for j, y in enumerate(ends[1]) if y > first and y - len(parts[1][j]) < x]
        rows.append((len(ids[0]), len(ids[1]), len(common), hashlib.sha256(";".join(said).encode()).hexdigest()))
        links.append(own)
    docs = Counter(p for own in links for p in set(own))
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    return [(n_a, n_b, n_groups, len(own), sum(docs[p] == best[p[0]] for p in own), sum(docs[p] for p in own), digest) for (n_a, n_b, n_groups, digest), own in zip(rows, links, strict=True)]


def test_alignment_of_hard_texts(spark, monkeypatch):
    texts = [t if t is None or len(t) < 2000 else t[:1500] for t in TEXTS]
    got = token_alignment.align(texts_table(spark, texts, extra=True).repartition(3), JSON, MODEL, public_tokenizers.PATTERN).collect()
    want = aligned(texts)
    rows = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert len(rows) == len(texts) and [rows[i or None] for i in range(len(texts))] == want
    assert want[8] == (0, 0, 0, 0, 0, 0, "")  # a literal U+2581 doesn't come back


def test_registered_alignment(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    short = sorted(docs, key=lambda i: len(docs[i] or ""))
    rows = {r["doc_id"]: r for r in entry.queries()["op13_token_alignment"](spark, SF).collect()}
    assert set(rows) == set(docs)
    for i, want in zip(short[:40], aligned([docs[i] for i in short[:40]]), strict=True):
        assert (rows[i]["n_a"], rows[i]["n_b"], rows[i]["n_groups"], rows[i]["n_links"], rows[i]["groups_sha256"]) == (*want[:4], want[6])
        assert rows[i]["n_best"] <= rows[i]["n_links"] <= rows[i]["count_sum"]


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(none, JSON, MODEL, public_tokenizers.PATTERN).count() == 0
    assert packing.pack_documents(none, JSON, public_tokenizers.PATTERN, 0).count() == 0
