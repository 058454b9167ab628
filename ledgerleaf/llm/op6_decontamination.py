"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton is built once on the driver from the normalised items and broadcast. One has at most
MAX_ITEM_WORDS words: a benchmark of more gives several automata, each built, broadcast and streamed in turn
and then forgotten, so that neither driver nor executors ever hold two. A longer item is cut into pieces that
overlap by one word less than a window, so that each of its windows lies in a piece. Training tokens stream past it; the longest match that ends at each
token is tracked, and where it reaches a window's length the words under the window are hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import common as C
from ledgerleaf.llm.words import LOWER

TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Words per automaton; each state costs some 200 bytes, so one stays under about 100 MB.
MAX_ITEM_WORDS = 250_000


class SuffixAutomaton:
    """States are classes of substrings with the same end positions; ``items`` has the item indexes per state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], item: int) -> None:
        last = 0
        for word in words:
            if (q := self.next[last].get(word)) is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
                last = new
            self.items[last].add(item)

    def finish(self) -> None:
        """Pass the items of each class on to its suffixes."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.items[self.link[s]] |= self.items[s]

    def holder(self, state: int, length: int) -> int:
        """The state that the suffix of this length, of a match that ends in ``state``, belongs to."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class Index:
    """Automaton, word numbers, and the windows' lengths with their items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.names = [name for name, _ in items]
        self.numbers: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        self.whole: dict[int, dict[tuple, set[int]]] = {}
        pairs = set()
        for k, (_, words) in enumerate(items):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            self.automaton.add(ids, k)
            pairs.update(zip(ids, ids[1:], strict=False))
            if len(ids) < window:
                self.whole.setdefault(len(ids), {}).setdefault(tuple(ids), set()).add(k)
        self.automaton.finish()
        self.window, self.size = window, len(self.numbers) + 1
        self.pairs = np.sort(np.array([a * self.size + b for a, b in pairs] or [-1], np.int64))
        self.shortest = min([window, *self.whole])

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items whose windows occur."""
        hit, found = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        # Matches of two words or more lie in runs of word pairs that items have; the automaton streams over these runs.
        code = ids[:-1] * self.size + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        known = np.concatenate([[False], (self.pairs[at] == code) & (ids[:-1] > 0) & (ids[1:] > 0), [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - start + 1 >= self.shortest:
                self._stream(ids[start : end + 1].tolist(), start, hit, found)
        for (word,), items in self.whole.get(1, {}).items():
            if (one := ids == word).any():
                hit |= one
                found |= items
        return hit, found

    def _stream(self, ids: list[int], start: int, hit: np.ndarray, found: set[int]) -> None:
        a = self.automaton
        step, link, size, window = a.next, a.link, a.length, self.window
        state = length = 0
        for i, word in enumerate(ids, start):
            while state and word not in step[state]:
                state = link[state]
                length = size[state]
            if word in step[state]:
                state, length = step[state][word], length + 1
            if length >= window:
                hit[i - window + 1 : i + 1] = True
                found |= a.items[a.holder(state, window)]
            for n, wholes in self.whole.items():
                if 1 < n <= length and (items := wholes.get(tuple(ids[i - start - n + 1 : i - start + 1]))):
                    hit[i - n + 1 : i + 1] = True
                    found |= items


def _pieces(text: bytes, window: int, limit: int) -> Iterator[list[bytes]]:
    """An item's words, at most ``limit`` at a time (or two windows, if that is more); a piece after the first has a window at least."""
    size, piece = max(limit, 2 * window), []
    for found in TOKEN.finditer(text):
        if len(piece) == size:
            yield piece
            piece = piece[size - window + 1 :]
        piece.append(found.group())
    if piece:
        yield piece


def indexes(benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_ITEM_WORDS) -> Iterator[Index]:
    """Automata over all items, as many as their words need, one at a time."""
    part, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).distinct().orderBy("i", "t").toLocalIterator():
        if row.t is None or row.i is None:
            continue
        for found in _pieces(row.t.encode().translate(LOWER), window, limit):
            if part and words + len(found) > limit:
                yield Index(part, window)
                part, words = [], 0
            part.append((row.i, found))
            words += len(found)
    yield Index(part, window)


def _find(shared):
    """(h1, h2, words, items) of the texts that have a hit: intervals of word numbers, and names."""

    def run(batches):
        C.at_work("op6")
        for batch in batches:
            rows = []
            for h1, h2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                hit, found = shared.value.hits(TOKEN.findall(text.as_py().translate(LOWER)) if text.is_valid else [])
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    rows.append((h1, h2, edge.tolist(), sorted({shared.value.names[k] for k in found})))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["h1", "h2", "words", "items"])

    return run


def _text_hashes() -> list:
    """128 bits that name a text."""
    return [F.xxhash64(F.col("text").cast("string")).alias("h1"), F.xxhash64(F.lit("again"), F.col("text").cast("string")).alias("h2")]


def _hits(docs: DataFrame, parts: Iterator[Index]) -> DataFrame:
    """(h1, h2, edges, items): what every automaton has found, a row for each text with a hit; automata take turns."""
    spark, out = docs.sparkSession, None
    slim = docs.select(*_text_hashes(), F.col("text").cast("string").alias("text"))
    for index in parts:
        shared = spark.sparkContext.broadcast(index)
        one, _ = C.written(slim.mapInArrow(_find(shared), "h1 long, h2 long, words array<long>, items array<string>").dropDuplicates(["h1", "h2"]), "found")
        shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out.groupBy("h1", "h2").agg(F.flatten(F.collect_list("words")).alias("edges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("names"))


def _scan(shared, clean: int | None, known: tuple[int, int] | None = None):
    """With one automaton the texts stream past it; with several, ``known`` are the columns of their edges and names."""

    def run(batches):
        C.at_work("op6")
        for batch in batches:
            rows = []
            given = zip(batch.column(known[0]).to_pylist(), batch.column(known[1]).to_pylist(), strict=True) if known else repeat((None, None))
            for text, (edges, found) in zip(batch.column(batch.schema.get_field_index("text")).cast(pa.binary()), given, strict=False):
                raw = text.as_py() if text.is_valid else b""
                low = raw.translate(LOWER)
                words = TOKEN.findall(low)
                if known:
                    hit, names = np.zeros(len(words), bool), set(found or [])
                    for a, b in zip((edges or [])[::2], (edges or [])[1::2], strict=True):
                        hit[a:b] = True
                else:
                    hit, f = shared.value.hits(words)
                    names = {shared.value.names[k] for k in f}
                spans = []
                if hit.any():
                    ends = [(m.start(), m.end()) for m in TOKEN.finditer(low)]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    spans = [(ends[a][0], ends[b - 1][1]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                if clean is None:
                    rows.append((len(words), int(hit.sum()), sorted(names), [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in spans]))
                elif not hit.any():
                    rows.append(text.as_py().decode() if text.is_valid else None)
                elif hit.sum() * 100 >= clean * len(words):
                    rows.append(False)
                else:
                    kept, last = [], 0
                    for a, b in spans:
                        kept.append(raw[last:a])
                        last = b
                    rows.append(b"".join([*kept, raw[last:]]).decode())
            if clean is None:
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())),
                    pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ], names=["doc_id", "n_words", "n_hit", "items", "spans"])
            else:
                keep = pa.array([r is not False for r in rows])
                changed = [r if r is not False else None for r in rows]
                out = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(changed, batch.schema.field("text").type))
                if (i := batch.schema.get_field_index("n_chars")) >= 0:
                    olds = zip(batch.column(i).to_pylist(), batch.column(batch.schema.get_field_index("text")).to_pylist(), changed, strict=True)
                    sizes = [n if r == t or r is None else len(r) for n, t, r in olds]
                    out = out.set_column(i, batch.schema.field(i), pa.array(sizes, batch.schema.field(i).type))
                out = out.filter(keep)
                yield out.select([n for i, n in enumerate(out.schema.names) if i not in known]) if known else out

    return run


def _streamed(slim: DataFrame, benchmark: DataFrame, window: int, limit: int, clean: int | None, schema) -> DataFrame:
    spark = slim.sparkSession
    parts = indexes(benchmark, window, limit)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return slim.mapInArrow(_scan(spark.sparkContext.broadcast(first), clean), schema)
    hits, _ = C.written(_hits(slim, chain([first, second], parts)), "hits")
    names = [C.unused(slim, n) for n in ("h1", "h2", "edges", "names")]
    hits = hits.toDF(*names)
    hashed = slim.select("*", *(h.alias(n) for h, n in zip(_text_hashes(), names[:2], strict=True)))
    joined = hashed.join(hits, names[:2], "left").select(*slim.columns, *names[2:])
    return joined.mapInArrow(_scan(None, clean, (len(slim.columns), len(slim.columns) + 1)), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_ITEM_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (ids, sorted as strings) and spans (code points, end exclusive).

    Texts are lower-cased in A-Z; words are runs of digits, letters and non-ASCII characters. A window is
    ``window`` consecutive words of an item, or a whole shorter item. Null and empty texts have no words and
    no hits; items without words, and items whose item_id is null, have no windows. Repeated rows each give their
    row; equal item_ids count once; an empty benchmark hits nothing. A very long text streams as any other. Other
    columns, whatever their names, do not matter. ``limit`` is the number of item words in an automaton.
    """
    C.small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _streamed(slim, benchmark, window, limit, None, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>")


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = 50, limit: int = MAX_ITEM_WORDS) -> DataFrame:
    """``docs`` with its own columns, hit spans cut out of the text; rows go whose hit words reach ``coverage`` percent.

    Rows without a hit, null and empty texts included, stay as they are; n_chars, where there is one, follows
    a changed text.
    """
    C.small_batches(docs.sparkSession)
    return _streamed(docs, benchmark, window, limit, coverage, docs.schema)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
