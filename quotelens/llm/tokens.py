"""Tokens of whole texts with the tokenizers library, one short fragment at a time.

A fragment is a piece of text that encodes alike wherever it stands, so each distinct fragment is encoded once per worker
and looked up afterwards. Two ways to find fragments:

* ``ForcedCuts`` for byte-level vocabularies: two neighbouring bytes that stand in no vocabulary token can never be merged.
* ``WhiteSpace`` for vocabularies whose pre-tokenizer drops white space: nothing is ever merged across it.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np

#: Bytes of fragments, ids and their table that one Python worker remembers, twice at most; beyond it those not met lately are forgotten; results do not change.
MEMORY, ENTRY = 40 << 20, 200


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def vocabulary_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; added tokens stand for their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, added = _byte_letters(), {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *added, 0]))
    for token, i in spec["model"]["vocab"].items():
        out[i] = added.get(i) or bytes(letters[c] for c in token)
    for i, content in added.items():
        out[i] = content
    return out


def _parted(raw: np.ndarray, at: np.ndarray, mark: bytes) -> bytes:
    """The bytes with a mark before each position of at."""
    out = np.empty(len(raw) + len(at), dtype=np.uint8)
    marks = at + np.arange(len(at))
    out[marks] = mark[0]
    rest = np.ones(len(out), dtype=bool)
    rest[marks] = False
    out[rest] = raw
    return out.tobytes()


class WhiteSpace:
    """Fragments for vocabularies whose pre-tokenizer drops white space and parts letters, single digits and signs.

    Cuts: ASCII white space, and every change between ASCII letters, digits and signs other than the apostrophe (it reads
    the letters behind it). ASCII letters are lower-cased first, as the vocabulary's normalizer does, so that fewer
    fragments differ; a text with the start of an added token's name is only cut at white space.
    """

    #: Of MEMORY; a byte-level vocabulary has longer fragments and more of them.
    share = 1.0

    def __init__(self, path: str):
        kinds = np.zeros(256, dtype=np.uint8)
        kinds[0x21:0x7F] = 3
        kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
        kinds[0x30:0x3A] = 2
        kinds[ord("'")] = 0
        self.kinds = kinds
        with open(path, encoding="utf-8") as f:
            self.names = {t["content"].encode()[:2] for t in json.load(f).get("added_tokens", [])}

    def split(self, data: bytes) -> list[bytes]:
        if any(name in data for name in self.names):
            return data.split()
        kinds = self.kinds[raw := np.frombuffer(data.lower(), dtype=np.uint8)]
        left, right = kinds[:-1], kinds[1:]
        return _parted(raw, np.flatnonzero((left != right) & (left > 0) & (right > 0)) + 1, b" ").split()


class ForcedCuts:
    """Fragments between forced boundaries.

    A cut stands between two bytes that are neighbours in no vocabulary token, so no merge crosses it. The pre-tokenizer
    of byte-level vocabularies looks ahead after white space and reads an apostrophe together with the letters behind it;
    so a cut also needs a left character that is not white space (of any script) and a right one that starts a character
    and is not an apostrophe. Between such neighbours the pre-tokenizer either ends a piece or stays inside a run of one
    class, and both sides encode as they do in the whole text.
    """

    share = 1.65

    def __init__(self, path: str):
        pairs = np.zeros((256, 256), dtype=bool)
        for token in vocabulary_bytes(path):
            raw = np.frombuffer(token, dtype=np.uint8)
            pairs[raw[:-1], raw[1:]] = True
        cut = ~pairs
        cut[:, 0x80:0xC0] = False
        cut[:, ord("'")] = False
        cut[[*range(0x09, 0x0E), *range(0x1C, 0x21)], :] = False
        self.cut = cut
        spaces = [c.encode() for c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
        self.spaces = {s for s in spaces}
        self.space_ends = np.isin(np.arange(256), [s[-1] for s in spaces])

    def split(self, data: bytes) -> list[bytes]:
        raw = np.frombuffer(data, dtype=np.uint8)
        at = np.flatnonzero(self.cut[raw[:-1], raw[1:]]) + 1
        if not len(at):
            return [data] if data else []
        doubtful = self.space_ends[raw[at - 1]]
        if doubtful.any():
            keep = ~doubtful
            for i in np.flatnonzero(doubtful):
                p = int(at[i])
                keep[i] = data[p - 2 : p] not in self.spaces and data[p - 3 : p] not in self.spaces
            at = at[keep]
        return _parted(raw, at, b"\xff").split(b"\xff")


class Encoder:
    """Ids of whole texts. Equal to the library's encode(text, add_special_tokens=False), without truncation or padding."""

    def __init__(self, path: str, cuts: type):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cuts = cuts(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; empty for null or empty text."""
        fragments = self.cuts.split((text or "").encode())
        try:
            return b"".join(map(self.known.__getitem__, fragments))
        except KeyError:
            self._learn(fragments)
        return b"".join(map(self.known.__getitem__, fragments))

    def _learn(self, fragments: list[bytes]) -> None:
        """Encode what isn't remembered. Fragments that were not met since the memory was last full are forgotten."""
        if self.size > MEMORY * self.cuts.share:
            self.known, self.older, self.size = {}, self.known, 0
        known, older = self.known, self.older
        missing = [f for f in set(fragments) if f not in known]
        known.update((f, older[f]) for f in missing if f in older)
        new = [f for f in missing if f not in older]
        for start in range(0, len(new), 1000):
            part = new[start : start + 1000]
            for f, e in zip(part, self.library.encode_batch([f.decode() for f in part], add_special_tokens=False), strict=True):
                known[f] = array("I", e.ids).tobytes()
        self.size += sum(ENTRY + len(f) + len(known[f]) for f in missing)


@lru_cache(maxsize=2)
def encoder(path: str, cuts: type) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path, cuts)


class Decoder:
    """Text of ids: the bytes of all tokens in a row, read as UTF-8; broken bytes become U+FFFD as in the library."""

    def __init__(self, path: str):
        self.bytes = vocabulary_bytes(path)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)
