"""Token ids of whole texts from a tokenizer file, remembered by pre-token.

The tokenizer cuts a text into pre-tokens and merges inside each alone, so a
text's ids are those of its pre-tokens in order.  ``keys`` gives a text's
pre-tokens, ``ids`` the ids of one.

The cut is made here where it is certain to be the library's: code points below
U+0250 without control characters or added tokens, for which NFC changes nothing
and lower-casing is one to one.  A text with anything else is cut at ASCII white
space, which nothing reaches across: no merge, no canonical composition and no
added token.  Of its runs, those that need it are encoded by the library as they
are; their key is the run after a zero.
"""

from __future__ import annotations

import json
import re
import struct

from tokenizers import Tokenizer

# The split pattern that the cut below is known to follow.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters and numbers below U+0250, lower case.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾"
_CUT = re.compile(f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_UNSURE = re.compile("[^\t\n\r\x20-\x7e¡-į\u0131-ɏ]|<\\|")
_RAW = "\0"


def runs(text: str) -> list[str]:
    """Pieces between ASCII white space."""
    return [run for run in re.split("[\t\n\r ]+", text) if run]


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself where printable."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b) if b in printable else chr(spare))
        spare += b not in printable
    return letters


class Encoder:
    """A tokenizer file, by pre-token."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): letter for b, letter in enumerate(_byte_letters())})
        self.known = self._follows_pattern(path)

    @staticmethod
    def _follows_pattern(path: str) -> bool:
        """Whether the file normalises and splits as the cut here does."""
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        normal = (parts.get("normalizer") or {}).get("normalizers") or []
        before = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or []
        added = [t["content"] for t in parts.get("added_tokens") or []]
        return (
            [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in before] == ["Split", "ByteLevel"]
            and before[0]["pattern"].get("Regex") == SPLIT
            and not before[1]["add_prefix_space"]
            and not before[1].get("use_regex", True)
            and parts["model"]["type"] == "BPE"
            and not parts["model"].get("dropout")
            and all(t.startswith("<|") for t in added)
        )

    def keys(self, text: str) -> list[str]:
        if not self.known:
            # Nothing is known of this tokenizer's cuts: the text is one.
            return [_RAW + text] if text else []
        if not _UNSURE.search(text):
            return _CUT.findall(text.lower())
        out: list[str] = []
        for run in runs(text):
            if _UNSURE.search(run):
                out.append(_RAW + run)
            else:
                out += _CUT.findall(run.lower())
        return out

    def ids(self, key: str) -> bytes:
        """Packed ids of a key."""
        if key.startswith(_RAW):
            return packed(self.tokenizer.encode(key[1:], add_special_tokens=False).ids)
        shown = key if key.isascii() else key.encode().decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.model.tokenize(shown)])

    def count(self, key: str) -> int:
        return len(self.ids(key)) // 4


LONGEST = 64  # characters of a key that is counted or remembered


class Generations(dict):
    """A bounded memory of ``make(key)``: what was asked for lately stays, the rest is made again.

    Entries are in two generations of half the capacity; the older one is given
    up whenever the younger is full.  ``pinned`` entries always stay.  Keys of
    more than ``LONGEST`` characters are made each time, so the bytes are bounded too.
    """

    def __init__(self, make, capacity: int, pinned: dict | None = None) -> None:
        super().__init__(pinned or {})
        self.make, self.pinned, self.older = make, pinned or {}, {}
        self.full = len(self.pinned) + max(1, capacity // 2)

    def __missing__(self, key: str):
        if len(key) > LONGEST:
            return self.make(key)
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.full:
            self.older = self.copy()
            self.clear()
            self.update(self.pinned)
        self[key] = found
        return found


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


REMEMBERED = 1_000_000  # pre-tokens a worker keeps

_encoders: dict[str, Encoder] = {}
_id_caches: dict[str, Generations] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_cache(path: str, capacity: int = REMEMBERED) -> Generations:
    """The worker's memory of key -> packed ids."""
    if path not in _id_caches:
        _id_caches[path] = Generations(encoder(path).ids, capacity)
    return _id_caches[path]


def count_cache(path: str, frequent: dict[str, int], capacity: int = REMEMBERED) -> Generations:
    """A memory of key -> number of ids, with a table of frequent keys that stays."""
    return Generations(encoder(path).count, capacity, frequent)
