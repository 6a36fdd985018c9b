"""SimHash, line dedup, MinHash and components against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import minhash, oracles, resemblance, simhash
from newsloom.llm.components import components
from newsloom.llm.line_dedup import CuckooFilter, LineIndex

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_fingerprint(text):
    words = [w for w in BLANK.split(lower(text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 60, 300]))) for _ in range(60)]
    out = [None, "", " \t\n", "One", "one", "A b C", "a B c"]
    for text in base:
        out.append(text)
        parts = text.split()
        for _ in range(rng.randrange(4)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
            out.append(" ".join(parts))
    return out


def test_fingerprints_and_components_match_brute_force(spark):
    texts = near_texts()
    rows = [(i + 10, t, "clash", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id long").repartition(3)
    fps = {i + 10: brute_fingerprint(t) for i, t in enumerate(texts)}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    expected = groups_of(fps, linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{fps[d]:016x}", expected[d]) for d in fps}


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for fp in fps:
        flips = rng.choice(64, rng.integers(0, 5), replace=False)
        other = fp ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else fp
        a, b = (set(simhash.replicas(np.array([x]), 2)[0].tolist()) for x in (fp, other))
        assert a & b


def test_wide_and_narrow_anchors_agree(monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 1 << 62, 4, dtype=np.uint64)
    fps = np.unique(np.array([c ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(d)) for c in centre for b in range(20) for d in range(20)], np.uint64))
    anchors = np.sort(rng.integers(0, 3, len(fps)))

    def closure():
        a, b = simhash._linked(anchors, fps, 4)
        return groups_of(fps.tolist(), list(zip(a.tolist(), b.tolist(), strict=True)))

    narrow = closure() if monkeypatch.setattr(simhash, "WIDE", 10_000) is None else None
    monkeypatch.setattr(simhash, "WIDE", 2)
    assert narrow == closure()


def test_simhash_of_rows_without_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "x y z w v u t s r q"), (9, "x y z w v u t s r q")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 7), (0, 7), (7, 7), (7, 7), (9, 7)]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    linked = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    expected = groups_of({x for pair in linked for x in pair}, linked)
    got = {r.node: r.root for r in components(spark.createDataFrame(linked, "a long, b long")).collect()}
    assert got == {n: r for n, r in expected.items() if n != r}


LINES = [
    (1, "This line is shared by three\nown line of the first document\n  THIS line is shared by three \r"),
    (2, "this line is shared by three\nshort\n\nshort"), (3, "x\nThis line is shared by three"), (4, None), (5, ""), (6, "only two hold this longer line"),
    (7, "only two hold this longer line\nshort\n"), (8, "ünïcödé lines count code points\nshort"), (9, "Ünïcödé lines count code points"), (10, "ünïcödé lines count code points"), (None, "this line is shared by three"),
]


def brute_lines(rows):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 20:
                holders[key(line)].add(doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stays = [x for x in lines if doc_id is None or len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == doc_id]
        out[doc_id] = (len(lines), len(lines) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest())
    return out


def kept(index, docs):
    rows = index.apply(docs).select("doc_id", "_lines", "_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")).collect()
    return {r.doc_id: (r[1], r[2], r.h) for r in rows}


def test_lines_match_brute_force_and_are_reversible(spark):
    docs = spark.createDataFrame([(d, t, "k") for d, t in LINES], "doc_id long, text string, key string")
    index = LineIndex(spark).insert(docs)
    assert kept(index, docs) == brute_lines(LINES)
    smaller = index.delete(spark.createDataFrame([(3,)], "doc_id long"))
    rest = [r for r in LINES if r[0] != 3]
    assert kept(smaller, docs.where("doc_id is null or doc_id <> 3")) == brute_lines(rest)
    again = smaller.insert(docs.where("doc_id = 3"))
    assert kept(again, docs) == brute_lines(LINES)
    assert kept(index, docs) == brute_lines(LINES)  # the first version is still there
    assert kept(again.compact(), docs) == brute_lines(LINES)
    assert kept(LineIndex(spark, again.folder, again.version), docs) == brute_lines(LINES)


def test_documents_that_come_again_are_replaced(spark):
    line = "a line that is long enough to count"
    one = spark.createDataFrame([(1, line)], "doc_id long, text string")
    index = LineIndex(spark).insert(one).insert(one).insert(one)
    assert index.repeated.count() == 0 and index.refs.count() == 1
    others = spark.createDataFrame([(2, line), (3, line)], "doc_id long, text string")
    index = index.insert(others)
    assert [(r.n_docs, r.keeper) for r in index.repeated.collect()] == [(3, 3)]
    index = index.insert(spark.createDataFrame([(3, "another text")], "doc_id long, text string"))
    assert index.repeated.count() == 0


def test_a_lost_filter_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(d, t) for d, t in LINES], "doc_id long, text string")
    index = LineIndex(spark, f"file://{tmp_path}/index").insert(docs)
    assert index.apply(docs).count() == len(LINES)
    for path in (tmp_path / "index/v1/filters").glob("*.cuckoo"):
        path.unlink()
    with pytest.raises(Exception):  # noqa: B017
        index.apply(docs).collect()


def test_clashing_names_pass_through(spark):
    names = ["_kept", "_lines", "_dropped", "_drop_id", "_drop_keys", "dropped", "row"]
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(i, line, *names) for i in range(4)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    made = LineIndex(spark).insert(docs).apply(docs)
    assert made.columns == [*docs.columns, "_lines_", "_dropped_"]
    for row in made.collect():
        assert [row[n] for n in names] == names and row["_lines_"] == 1 and row["_dropped_"] == (row.doc_id < 3)
    passed = corpus_pipeline.lines(spark, docs, "")
    assert passed.columns == docs.columns and sorted(r.text for r in passed.collect()) == ["", "", "", line]


def test_many_lines_and_keys_in_one_document(spark):
    many = "\n".join(f"line number {i} is long enough to count" for i in range(20_000))
    docs = spark.createDataFrame([(i, many) for i in range(3)] + [(9, "short")], "doc_id long, text string")
    began = time.monotonic()
    assert {r.doc_id: r._dropped for r in LineIndex(spark).insert(docs).apply(docs).collect()} == {0: 20_000, 1: 20_000, 2: 0, 9: 0}
    assert time.monotonic() - began < 100


def test_line_sql_agrees(spark):
    rows = [r for r in LINES if r[0] is not None]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = connection.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({oracles.LINE_DEDUP})").fetchall()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_lines(rows)


def test_lines_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert LineIndex(spark).insert(none).apply(none).count() == 0


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    made = CuckooFilter(len(keys))
    assert made.insert(keys) and made.may_hold(keys).all()
    others = rng.integers(-(1 << 62), 1 << 62, 20_000)
    assert made.may_hold(others).mean() < 0.01
    made.delete(keys[:2500])
    assert made.may_hold(keys[2500:]).all() and made.may_hold(keys[:2500]).mean() < 0.01


def jaccard(a, b):
    def shingles(text):
        words = [w for w in BLANK.split(text.lower()) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_minhash_table(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 4, 5, 6, 30, 200, 1000, 1500, 1500)]
    texts[7] = texts[6] + " " + texts[7]
    texts += [texts[8], None, "é" * 10]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(10 * i, t, 1) for i, t in rows], "doc_id long, text string, next_id int").repartition(5)
    got = {r.doc_id: r for r in minhash.fingerprint_table(docs).collect()}
    assert len(got) == len(texts)
    errors = []
    for i, t in rows:
        text, after = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        row = got[10 * i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(row.fingerprint) == 2 * minhash.BINS and 0 <= row.near_edited <= 1
        if len(text.split()) >= 100:
            errors.append(abs(row.near_edited - jaccard(text, edited)))
            errors.append(abs(row.near_next - jaccard(text, after)))
    assert np.mean(errors) < 0.05 and max(errors) < 0.15
    assert got[80].fingerprint == got[100].fingerprint and got[0].fingerprint == got[110].fingerprint


def test_minhash_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "one two three four five six"), (4, "another text of the same id")], "doc_id long, text string")
    rows = minhash.fingerprint_table(docs).collect()
    assert len(rows) == 3 and [r.near_next for r in rows if r.doc_id is None] == [0.0]
    assert minhash.fingerprint_table(docs.where("false")).count() == 0


def test_densification_is_uniform(spark):
    """Texts of few shingles still estimate well: donors are drawn independently."""
    rng = random.Random(8)
    pairs = []
    for i in range(60):
        words = [f"x{rng.randrange(10**6)}" for _ in range(24)]
        other = words[:16] + [f"y{rng.randrange(10**6)}" for _ in range(8)]
        pairs.append((i, " ".join(words), " ".join(other)))
    frame = spark.createDataFrame(pairs, "doc_id long, a string, b string")
    made = minhash.with_fingerprint(minhash.with_fingerprint(frame, "a", "fa"), "b", "fb")
    mean = made.select(F.avg(minhash.likeness(F.col("fa"), F.col("fb")))).first()[0]
    assert abs(mean - 12 / 28) < 0.08


def jaccard_groups(texts):
    cut = lambda t: [w for w in BLANK.split(lower(t or "")) if w]
    held = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := cut(t)) else set() for d, t in texts.items()}
    similar = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    return groups_of(held, [(a, b) for a in held for b in held if a < b and similar(held[a], held[b])])


def test_wide_covering():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, (200, resemblance.WORDS), dtype=np.uint64)
    held = [set() for _ in fps]
    for anchors, row in resemblance.replicas(fps):
        for a, r in zip(anchors.tolist(), row.tolist(), strict=True):
            held[r].add(a)
    for table in range(resemblance.TABLES):  # one bit of each block changed: they still meet in every table
        for i in range(0, 200, 10):
            bits = np.unpackbits(fps[i, 1:].copy().view(np.uint8), bitorder="little")
            for block in (0, 1):
                bits[2 * resemblance.GOLAY * table + resemblance.GOLAY * block + rng.integers(resemblance.GOLAY)] ^= 1
            other = np.concatenate([fps[i, :1], np.packbits(bits, bitorder="little").view("<u8")])[None]
            assert any(held[i] & set(anchors.tolist()) for anchors, _ in resemblance.replicas(other))
            own = {a for a in held[i] if a >> 24 == table}
            assert own & {a for anchors, _ in resemblance.replicas(other) for a in anchors.tolist()}
    assert 25 * resemblance.TABLES < np.mean([len(h) for h in held]) < 31 * resemblance.TABLES


def test_resemblance_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    hot = [rng.choice(words) for _ in range(200)]
    texts = [*near_texts()]
    for _ in range(60):  # many edited copies of one text, not all of them similar to each other
        parts = list(hot)
        for at in rng.sample(range(200), rng.randrange(1, 6)):
            parts[at] = rng.choice(words)
        texts.append(" ".join(parts))
    for n in range(1, 12):  # about the threshold: n of 60 words changed at the end
        base = [rng.choice(words) for _ in range(60)]
        texts += [" ".join(base), " ".join([*base[: 60 - n], *(rng.choice(words) for _ in range(n))])]
    rows = {i + 10: t for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows.items()], "doc_id long, text string, component_id long").repartition(3)
    made, exact = {r.doc_id: r.component_id for r in resemblance.groups(docs).collect()}, jaccard_groups(rows)
    assert made.keys() == exact.keys()
    for doc_id, component in made.items():  # no group joins what brute force keeps apart
        assert exact[doc_id] == exact[component]
    missed = [d for d in made if made[d] != exact[d]]
    assert len(missed) <= 0.1 * sum(exact[d] != d for d in exact)
    assert resemblance.groups(docs.where("false")).count() == 0
    bare = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, "other words")], "doc_id long, text string")
    assert sorted(r.component_id or 0 for r in resemblance.groups(bare).collect()) == [0, 7, 7, 7]


def test_pipeline_drops_edited_copies_beyond_four_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    roots = jaccard_groups({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(roots.values())
