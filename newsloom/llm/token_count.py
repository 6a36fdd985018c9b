"""Token counts by a deterministic transducer compiled from a BPE tokenizer's merges.

The transducer reads a pre-token byte by byte. Its state holds, for each place where a vocabulary entry
could still be growing, the entry's place in the vocabulary's tree, the token that the encoding of the
text before it ends with, and by how many tokens that encoding is shorter. A transition finds the one
token that ends here and that may follow the token before it, and is annotated with the change of the
token count. States are made as texts need them, shared by all words, and forgotten together when too many.

Text is cut into pre-tokens by the tokenizer's pattern, a regular stage of its own whose cuts leave the transducer in its
start state; pre-tokens are remembered with their counts. Long texts are cut in pieces where a cut is certain
whatever stands before and behind (before white space, and where letters, numbers and marks meet).

A pre-token longer than CHUNK bytes (scripts without blanks, encoded data) is counted by chunks. A chunk's map takes
each state that it is entered in to the state it is left in and the tokens emitted; maps compose associatively, and a
scan over them by pairs gives the state and count at each chunk's end. Only a bounded number of maps is held.

Tokenizers that are not byte-level, and patterns other than the byte-level one, go to the library whole.

Defined results: a null or empty text has zero tokens; other columns play no part; repeated rows give
repeated results; a text of any length is counted whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import vocab
from newsloom.llm.common import kept_in_worker, map_rows

#: Pre-tokens that a worker remembers, the longest of them in characters, and states.
MEMO, LONGEST, STATES = 500_000, 64, 150_000
#: Characters of a piece, bytes of a chunk, and chunk maps that are composed at a time.
PIECE, CHUNK, MAPS = 1 << 16, 1 << 14, 64
NEVER = 1 << 60
#: Where a cut is certain: before white space, and between letters, numbers and marks, but for what an apostrophe starts.
_sure = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")

#: Transducer states as they are known beyond a worker's memory: places with the token before and how far behind each is.
State = tuple
ChunkMap = dict[State, tuple[State, int]]


START: State = ((0, None, 0),)


class CountTransducer:
    """Counts a pre-token's tokens; letters stand for bytes."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.made: dict[tuple[str, str], int] = {}
        self.split: dict[str, tuple[str, str, int]] = {}
        for rank, pair in enumerate(merges):
            if pair not in self.made:
                self.made[pair] = rank
                self.split.setdefault(pair[0] + pair[1], (*pair, rank))
        self.children: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for token in [*vocab.byte_letters().values(), *self.split]:
            self._plant(token)
        self.spines: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.forget()

    def _plant(self, token: str) -> None:
        node = 0
        for letter in token:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.token.append(None)
            node = self.children[node][letter]
        self.token[node] = token

    def forget(self) -> None:
        self.states, self.number, self.next = [START], {START: 0}, [{}]

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one end of token while its merges happen, each with the rank of the merge that ends it."""
        key = (token, side)
        if key not in self.spines:
            out, until = [], NEVER
            while True:
                out.append((token, until))
                if token not in self.split:
                    break
                until = self.split[token][2]
                token = self.split[token][side]
            self.spines[key] = out
        return self.spines[key]

    def _whole(self, token: str) -> bool:
        """Whether token's own text is encoded as token alone."""
        if token not in self.split:
            return True
        left, right, rank = self.split[token]
        return self._whole(left) and self._whole(right) and not self._joined(left, right, rank)

    def _joined(self, left: str, right: str, before: int = NEVER) -> bool:
        """Whether a merge of a rank under `before` joins the end of left to the start of right."""
        for a, a_ends in self._spine(left, 1):
            for b, b_ends in self._spine(right, 0):
                rank = self.made.get((a, b))
                if rank is not None and rank < before and rank < a_ends and rank <= b_ends:
                    return True
        return False

    def _may_follow(self, last: str | None, token: str) -> bool:
        key = (last, token)
        if key not in self.pairs:
            if len(self.pairs) > 4 * STATES:
                self.pairs.clear()
            self.pairs[key] = self._whole(token) and (last is None or not self._joined(last, token))
        return self.pairs[key]

    def _grow(self, state: int, letter: str) -> tuple[int, int]:
        best, change, going = None, 0, []
        for node, last, behind in self.states[state]:
            child = self.children[node].get(letter)
            if child is None:
                continue
            if best is None and (token := self.token[child]) is not None and self._may_follow(last, token):
                best, change = token, behind + 1
            if self.children[child]:
                going.append((child, last, behind))
        after = (*((node, last, behind - change) for node, last, behind in going), (0, best, 0))
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
            self.next.append({})
        self.next[state][letter] = step = (self.number[after], change)
        return step

    def run(self, entered: State, letters: str) -> tuple[State, int]:
        """The state after letters and the tokens emitted."""
        if len(self.states) > STATES:
            self.forget()
        if entered not in self.number:
            self.number[entered] = len(self.states)
            self.states.append(entered)
            self.next.append({})
        state, total = self.number[entered], 0
        transitions = self.next
        for letter in letters:
            step = transitions[state].get(letter) or self._grow(state, letter)
            state = step[0]
            total += step[1]
        return self.states[state], total

    def count(self, letters: str) -> int:
        return self.run(START, letters)[1]

    def chunk_map(self, data: bytes, entered: Iterable[State]) -> ChunkMap:
        letters = vocab.spelled(data)
        return {state: self.run(state, letters) for state in entered}

    def count_long(self, data: bytes) -> int:
        """A pre-token of any length, by the composition of its chunks' maps."""
        whole: ChunkMap = {START: (START, 0)}
        maps: list[ChunkMap] = []
        for i in range(0, len(data), CHUNK):
            entered = {state for state, _ in (maps[-1] if maps else whole).values()}
            maps.append(self.chunk_map(data[i : i + CHUNK], entered))
            if len(maps) == MAPS:
                whole, maps = compose(whole, scan(maps)[-1]), []
        return compose(whole, scan(maps)[-1])[START][1] if maps else whole[START][1]


def compose(x: ChunkMap, y: ChunkMap) -> ChunkMap:
    """What x and then y do; y knows all states that x is left in."""
    return {state: (y[left][0], emitted + y[left][1]) for state, (left, emitted) in x.items()}


def scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """Inclusive prefix compositions, in a logarithmic number of steps: pairs first, then the odd places from the pairs' prefixes."""
    if len(maps) < 2:
        return maps
    pairs = scan([compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
    return [maps[0], *(pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], maps[i]) for i in range(1, len(maps)))]


class Counter(dict):
    """Counts of pre-tokens, remembered; whole texts by pieces."""

    def __init__(self, data: bytes, pattern: str):
        self.data, self.held = data, None
        self.by_library = not vocab.is_byte_level(data) or pattern != vocab.BYTE_LEVEL_PATTERN
        special = vocab.special_strings(data)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        if not self.by_library:
            _, merges = vocab.parse_merges(data)
            self.transducer = CountTransducer(merges)
            self.split = vocab.splitter(pattern)

    @property
    def library(self):
        if self.held is None:
            from tokenizers import Tokenizer

            self.held = Tokenizer.from_str(self.data.decode())
            self.held.no_truncation()
            self.held.no_padding()
        return self.held

    def __missing__(self, token: str) -> int:
        if len(token) > LONGEST:
            return self.transducer.count_long(token.encode())
        if len(self) >= MEMO:
            self.clear()
        self[token] = n = self.transducer.count(vocab.spelled(token.encode()))
        return n

    def _cut(self, text: str) -> list[str]:
        if vocab.cuts_alike(text):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> Iterator[str]:
        """text in pieces of about PIECE characters, parted where a cut is certain."""
        start = 0
        while len(text) - start > PIECE:
            for cut in _sure.finditer(text, start + PIECE):
                at = cut.start()
                if vocab.cuts_alike(text[at - 1 : at + 1]):
                    break
            else:
                break
            yield text[start:at]
            start = at
        yield text[start:]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.by_library:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        plain = [text] if self.special is None else self.special.split(text)
        return len(plain) - 1 + sum(sum(map(self.__getitem__, self._cut(piece))) for part in plain for piece in self.pieces(part))


def counter(data: bytes, pattern: str) -> Counter:
    key = f"counter {hashlib.sha256(data).hexdigest()} {pattern}"
    return kept_in_worker(key, lambda: Counter(data, pattern))


def count_tokens(docs: DataFrame, json_path: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab.read_bytes(json_path))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = counter(sent.value, pattern)
        got = [own.count(text) for text in batch.column(1).to_pylist()]
        sizes = pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
        return pa.record_batch([batch.column(0), sizes, pa.array(got, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = map_rows(docs.select("doc_id", "text"), "text", "doc_id long, n_bytes long, n_tokens long", work)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
