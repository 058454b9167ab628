"""Token ids of whole texts by the tokenizers library, with a bounded cache of pre-tokens.

Both vocabularies cut a text into pre-tokens by a pattern and merge within each one alone. For texts of
Latin-1 characters the patterns below are the same cut (one library drops white space and lower-cases, the
other keeps a space before a word); each distinct pre-token then goes to the library once and is remembered.
The library's merges get thousands of them at once, in the byte alphabet of the vocabulary and one to a line,
which spares its general pipeline. Any other text goes to the library whole. Tests hold the ids against the library's for random texts.
"""

from __future__ import annotations

import os
import re

import numpy as np

from ledgerleaf.llm.common import forgets

_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
_DROPS_SPACE = re.compile(f"{_ENDINGS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_KEEPS_SPACE = re.compile(f"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\\x00-\\xff]")
#: Pre-tokens in a generation of the cache; two generations are kept, and what is still in use moves to the newer.
LIMIT = 400_000
_made: dict[str, "Encoder"] = {}
forgets.append(_made.clear)


def byte_alphabet() -> dict[int, str]:
    """The printable characters of Latin-1 stand for their own bytes; the other bytes take characters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = byte_alphabet()
_STOP = _BYTES[10]


class _Places(dict):
    def __missing__(self, word: str) -> bytearray:
        self[word] = place = bytearray()
        return place


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.keeps_space = self.whole("a a") != self.whole("a") * 2
        self.pattern = _KEEPS_SPACE if self.keeps_space else _DROPS_SPACE
        #: The same merges behind a pipeline that only splits lines.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.stop = self.merges.encode(_STOP).ids
        probe = ["a", "the", "über", "1"]
        self.plain = len(self.stop) == 1 and self._merged(probe) == [self.whole(x) for x in probe]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, tokens: list[str]) -> list[bytes]:
        """The ids of each pre-token; none holds a line end, which stands between them."""
        out: list[bytes] = []
        for i in range(0, len(tokens), 1000):
            part = tokens[i : i + 1000]
            # line ends become stops like other bytes; then each stands on a line of its own
            lines = "\n".join([*part, ""]).encode().decode("latin-1").translate(_BYTES).replace(_STOP, f"\n{_STOP}\n")
            ids = np.array(self.merges.encode_batch_fast([lines], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(ids == self.stop[0]).tolist()
            if len(stops) != len(part):
                raise RuntimeError("a pre-token has the line end's id")
            raw, at = ids.tobytes(), 0
            for z in stops:
                out.append(raw[4 * at : 4 * z])
                at = z + 1
        return out

    def _learn(self, places: dict[str, bytearray]) -> None:
        """The ids of pre-tokens that a batch has and the newer cache has not, there and in their places."""
        new, old = self.new, self.old
        ask = []
        for w in places:
            if (ids := old.get(w)) is None:
                ask.append(w)
            else:
                new[w] = ids
        bare = [w for w in ask if "\n" not in w] if self.plain else []
        new.update(zip(bare, self._merged(bare), strict=True))
        rest = [w for w in ask if w not in new]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            new[w] = np.array(e.ids, "<u4").tobytes()
        for w, place in places.items():
            place += new[w]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.new) > LIMIT:
            self.old, self.new = self.new, {}
        # One look-up for each pre-token: what the cache lacks has a place, which is filled before the ids are joined.
        find, get, places = self.pattern.findall, self.new.get, _Places()
        ids: list[list | None] = []
        for t in texts:
            if _OTHER.search(t):
                ids.append(None)
            else:
                ids.append([get(w) or places[w] for w in find(t if self.keeps_space else t.lower())])
        if places:
            self._learn(places)
        return [self.whole(t) if x is None else b"".join(x) for t, x in zip(texts, ids, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


def encoder(path: str) -> Encoder:
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
