"""Reading public vocabulary files and splitting text the way their encoders do."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import regex


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1
    letters stand for themselves, the others take the letters from U+0100 on, in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def spelled(data: bytes) -> str:
    letters = byte_letters()
    return "".join([letters[b] for b in data])


def spelled_lines(words: list[str]) -> str:
    """The words as spelled() would give them, a line each; none may hold a line break."""
    text = "\n".join(words).encode().decode("latin-1")
    for byte, letter in byte_letters().items():
        own = chr(byte)
        if own != letter and byte != 10 and own in text:
            text = text.replace(own, letter)
    return text


def read_bytes(path: str) -> bytes:
    """A vocabulary file, on the driver; tasks get its bytes by broadcast."""
    return Path(path).read_bytes()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def parse_merges(data: bytes) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and ordered merges of a tokenizer's JSON."""
    model = json.loads(data)["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return model["vocab"], pairs


def is_byte_level(data: bytes) -> bool:
    """Whether a tokenizer's JSON cuts plain text by the pattern and spells bytes, so that pre-tokens can be encoded one by one."""
    whole = json.loads(data)
    cut = whole.get("pre_tokenizer") or {}
    return whole.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")


def special_strings(data: bytes) -> dict[str, int]:
    """The added tokens that the library finds in plain text."""
    return {t["content"]: t["id"] for t in json.loads(data).get("added_tokens", [])}


#: Fixed value: the pattern by which byte-level tokenizers cut text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that cuts text by pattern. Texts in Latin-1 take the standard library's faster engine if it is the
    byte-level pattern, with its classes of letters, numbers and white space spelled out for those 256 code points."""
    if pattern != BYTE_LEVEL_PATTERN:
        whole = regex.compile(pattern)
        return lambda text: [m.group() for m in whole.finditer(text)]
    latin = [chr(c) for c in range(256)]
    classes = {name: "".join(re.escape(c) for c in latin if regex.match(name, c)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    own = pattern.replace(r"\S", "[^" + classes[r"\s"] + "]").replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(classes.values()) + "]")
    for name, members in classes.items():
        own = own.replace(name, f"[{members}]")
    fast, full = re.compile(own).findall, regex.compile(pattern).findall

    def cut(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return fast(text)

    return cut


#: The code points at which the regex module and the tokenizers library put characters in
#: the same classes (letters, numbers, space). Texts with others, all of them letters and numbers that
#: newer Unicode versions added, are cut by the library itself.
ALIKE = "\u0000-\u0557\u058d-\u088e\u0890-\u0c5b\u0cdd-\u208e\u20a0-\ua7cd\ua7f2-\uab6b\uab6e-\U000107ba\U0001f000-\U0001faff"
_unlike = regex.compile(f"[^{ALIKE}]")


def cuts_alike(text: str) -> bool:
    """Whether the pattern cuts text just as the tokenizers library does."""
    return text.isascii() or _unlike.search(text) is None
