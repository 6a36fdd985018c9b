"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text knows every substring of it. A text is parsed into
phrases, each the longest match that starts where the last one ended; the fewer phrases a language needs,
the closer it is. Phrases are weighted by log2 of the language's amount of text, the bits that name a place
in it. The language with the fewest bits wins, by name on ties.

Fitting takes a bounded sample of labelled rows: for each language the `buckets` rows that have the least
hash of their doc_id in their bucket, in that order; of each the first `row_chars` letters and blanks, cut inside
tasks, and of all of them the first `chars`. Only that comes to the driver. Automata are built once a worker from
the sample's text: as a table of states by letters if it is small, else as a double array of the transitions that
there are, so that large alphabets take no more memory than their text.

Predicting covers whole texts. Texts are lower-cased; all that is no letter, nor a mark on one, counts as one blank.
They are parsed in blocks of BLOCK letters and blanks, for all languages alike, many blocks in step.

Defined results: a null text or one without letters is `und` with score 0, and so is every text when no row
is labelled; other columns play no part; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import kept_in_worker, map_rows

BLOCK = 1024
#: How sharply the score falls with the relative distance of the other languages.
SHARP = 20.0
_MISS, _STATE = 1 << 30, (1 << 30) - 1
#: Entries that the tables of all languages may have together; automata that would take more become double arrays.
DENSE = 1 << 25
_latin_rest = re.compile(r"[\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+")
_rest, _letter = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters_of(text: str | None) -> str:
    """text in lower case with one blank for each run of other characters; empty if it has no letter."""
    text = (text or "").lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _rest.sub(" ", text).strip() if _letter.search(text) else ""
    return _latin_rest.sub(" ", text).strip()


def suffix_automaton(text: str, codes: dict[str, int]) -> list[dict[int, int]]:
    """Transitions of each state by letter code; 0 is the start. Code 1 parts texts."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def state(steps: dict[int, int], to: int, size: int) -> int:
        moves.append(steps)
        link.append(to)
        length.append(size)
        return len(moves) - 1

    def target(p: int, c: int) -> int:
        """The state of p's longest string and letter c, parted from longer strings if need be."""
        q = moves[p][c]
        if length[q] == length[p] + 1:
            return q
        copy = state(dict(moves[q]), link[q], length[p] + 1)
        link[q] = copy
        while p != -1 and moves[p].get(c) == q:
            moves[p][c] = copy
            p = link[p]
        return copy

    last = 0
    for letter in text:
        c = codes.get(letter, 1)
        if c == 1:  # a parting between texts: no phrase crosses it
            last = 0
        elif c in moves[last]:
            last = target(last, c)
        else:
            new, p = state({}, 0, length[last] + 1), last
            while p != -1 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p != -1:
                link[new] = target(p, c)
            last = new
    return moves


class Table:
    """Transitions by state * width + code, states premultiplied by width. A missing one starts a phrase: it
    carries the miss flag and leads where the letter leads from the start. Code 1, letters without a code,
    misses everywhere."""

    def __init__(self, moves: list[dict[int, int]], width: int):
        between = len(moves)  # where every letter starts a phrase: at first, and behind a letter that has no match
        if (between + 1) * width > _STATE:
            raise OverflowError(f"{between} states by {width} letters")
        table = np.full((between + 1, width), between * width, np.int32)
        for c, to in moves[0].items():
            table[:, c] = to * width
        table |= _MISS
        for number, steps in enumerate(moves):
            for c, to in steps.items():
                table[number, c] = to * width
        self.table, self.first = table.ravel(), between * width

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after codes, and whether each started a phrase."""
        to = self.table[state + codes]
        return to & _STATE, to >> 30


class DoubleArray:
    """The same by the transitions that there are: that of a state by a code stands at the state's base plus the code, if the
    state is its owner there."""

    def __init__(self, moves: list[dict[int, int]], width: int):
        between = self.first = len(moves)
        size = sum(map(len, moves))
        self.base = np.zeros(between + 1, np.int64)
        self.owner, self.to = np.full(2 * size + 2 * width, -1, np.int32), np.zeros(2 * size + 2 * width, np.int32)
        self.start = np.full(width, between, np.int64)
        for c, to in moves[0].items():
            self.start[c] = to
        free = 0  # no place before it is free
        for number in sorted(range(between), key=lambda n: -len(moves[n])):
            if not moves[number]:
                continue
            codes = np.fromiter(sorted(moves[number]), np.int64)
            at = max(0, free - int(codes[0]))
            while True:
                while at + 64 + width > len(self.owner):
                    self.owner, self.to = np.append(self.owner, np.full(len(self.owner), -1, np.int32)), np.append(self.to, np.zeros(len(self.to), np.int32))
                fits = np.flatnonzero((self.owner[np.arange(at, at + 64)[:, None] + codes] < 0).all(axis=1))
                if len(fits):
                    break
                at += 64
            self.base[number] = at = at + int(fits[0])
            self.owner[at + codes] = number
            self.to[at + codes] = [moves[number][c] for c in codes.tolist()]
            if len(codes) == 1:  # the many states with one way on fill the gaps in order
                free = at + int(codes[0])

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[state] + codes
        known = self.owner[at] == state
        return np.where(known, self.to[at], self.start[codes]), ~known


class Parser:
    """The automata of a sample: language to text."""

    def __init__(self, sample: dict[str, str]):
        self.languages = sorted(sample)
        alphabet = sorted(set("".join(sample.values())) - {"\n"})
        codes = {letter: i + 2 for i, letter in enumerate(alphabet)}
        self.width = width = len(codes) + 2
        made = [suffix_automaton(sample[x], codes) for x in self.languages]
        small = sum(map(len, made)) * width <= DENSE
        self.tables = [Table(moves, width) if small else DoubleArray(moves, width) for moves in made]
        self.weights = np.array([np.log2(len(sample[x]) + 1) for x in self.languages])
        self.code_of = np.ones(0x110000, np.uint8 if width < 256 else np.uint16)
        for letter, code in codes.items():
            self.code_of[ord(letter)] = code

    def bits(self, texts: list[str]) -> np.ndarray:
        """Bits of each text, by language, from texts of letters and blanks."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = self.code_of[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(lengths) - lengths, blocks) + number * BLOCK
        size = np.minimum(lengths[owner] - number * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        steps = np.zeros((int(size[0]) if len(size) else 0, len(owner)), self.code_of.dtype)
        active = np.searchsorted(-size, -np.arange(len(steps)), side="left")
        for lane, (a, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
            steps[:n, lane] = codes[a : a + n]
        out = np.zeros((len(texts), len(self.languages)))
        for i, table in enumerate(self.tables):
            state, phrases = np.full(len(owner), table.first, np.int64), np.zeros(len(owner), np.int64)
            for t, n in enumerate(active.tolist()):
                state[:n], started = table.step(state[:n], steps[t, :n])
                phrases[:n] += started
            out[:, i] = np.bincount(owner, phrases, len(texts)) * self.weights[i]
        return out


def parser(sample: dict[str, str]) -> Parser:
    key = "parser " + hashlib.sha256(repr(sorted(sample.items())).encode("utf-8", "surrogatepass")).hexdigest()
    return kept_in_worker(key, lambda: Parser(sample))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, buckets: int = 64, chars: int = 40_000, row_chars: int = 2_500) -> dict[str, str]:
    """The sample of docs (doc_id, text, lang) by language, its texts parted by line breaks."""
    labelled = docs.where("doc_id is not null and text is not null and lang is not null")
    mark = F.struct(F.xxhash64("doc_id", F.lit("sample")).alias("h"), "doc_id")
    chosen = labelled.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("b")).agg(F.min(mark).alias("m")).select("lang", F.col("m.h").alias("h"), F.col("m.doc_id").alias("doc_id"))
    own = labelled.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.set_column(2, "text", pa.array([letters_of(t)[:row_chars] for t in batch.column(2).to_pylist()], pa.string()))

    some = map_rows(own.select("lang", "doc_id", "text", "h"), "text", "lang string, doc_id long, text string, h long", cut)
    rows = some.groupBy("lang", "h", "doc_id").agg(F.min("text").alias("text")).collect()  # buckets rows a language, each of row_chars at most
    sample: dict[str, str] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["h"], r["doc_id"])):
        held = sample.setdefault(row["lang"], "")
        if row["text"] and len(held) < chars:
            sample[row["lang"]] = (held + "\n" + row["text"])[:chars]
    return {lang: text for lang, text in sample.items() if text}


def judge(texts: list[str | None], sample: dict[str, str]) -> tuple[list[str], np.ndarray]:
    """Language and score of texts, inside a task."""
    clean = [letters_of(t) for t in texts]
    known = [i for i, t in enumerate(clean) if t] if sample else []
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    if known:
        own = parser(sample)
        bits = own.bits([clean[i] for i in known])
        score[known] = 1 / np.exp(-SHARP * (bits / bits.min(axis=1, keepdims=True) - 1)).sum(axis=1)
        for i, b in zip(known, bits.argmin(axis=1).tolist(), strict=True):
            lang[i] = own.languages[b]
    return lang, score


def predict(docs: DataFrame, sample: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = judge(batch.column(1).to_pylist(), sent.value)
        return pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return map_rows(docs.select("doc_id", "text"), "text", "doc_id long, lang_pred string, score double", work)


def keep_identified(docs: DataFrame, sample: dict[str, str], least: float) -> DataFrame:
    """The rows of docs, all columns, whose language is found with a score of at least `least`; all that have letters
    where the sample is empty; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        if not sent.value:
            return batch.filter(pa.array([letters_of(t) != "" for t in texts], pa.bool_()))
        lang, score = judge(texts, sent.value)
        return batch.filter(pa.array((np.array(lang) != "und") & (score >= least)))

    return map_rows(docs, "text", docs.schema, work)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang); learns from rows not held out only."""
    sample = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, sample).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
