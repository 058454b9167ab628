"""Repeated passages by fixed-block anchors.

Each document's non-overlapping blocks of BLOCK words are the reference index; every rolling window of BLOCK
words of every document probes it. Any passage of WINDOW words holds a whole block wherever it starts, so
every repeat leaves at least one hit on either side. Hits are extended to maximal exact repeats by looking
up the passages around them, each by two 64-bit hashes, with the smallest doc_id that has it: a passage that
has a smaller one is removed, and runs of such passages are the maximal repeats. Of a passage that a chunk of
documents has several times only the one of the smallest doc_id is looked up: the others are late already.

Probes travel packed: one row for each chunk of documents and bucket of hashes, with 32 bits of each hash
beside the bucket's, so that a window costs about seven bytes of shuffle. A false hit costs a lookup and
changes nothing. Buckets hold a bounded number of windows, and a task works on one bucket at a time; a passage
that very many documents share adds at most one window for each of them to a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import common as C
from ledgerleaf.llm.words import WORD, mixed, word_hashes

BLOCK, WINDOW = 25, 50
#: Windows that a bucket holds on average, and bytes of spans up to which they are broadcast to the texts.
BUCKET_WINDOWS, BROADCAST_BYTES = 3_000_000, 32 << 20
LAST = (1 << 63) - 1
_BASE, _SECOND = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def rolling(h: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hashes of all runs of ``width`` words: sum of h[i + j] * base^j, mixed, by prefix sums modulo 2^64."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    back = np.full(n, inverse, np.uint64)
    back[:1] = 1
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h), base), dtype=np.uint64)])
    return mixed((prefix[width:] - prefix[:n]) * np.multiply.accumulate(back, dtype=np.uint64))


def _read(batch, i=1) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, all word hashes one after the other, and where each text's begin."""
    words = [WORD.findall(t.as_py()) if t.is_valid else [] for t in batch.column(i).cast(pa.binary())]
    edge = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return words, word_hashes([x for w in words for x in w]), edge


def _valid(edge: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of windows within one text, and the text of each."""
    size = np.diff(edge)
    owner = np.repeat(np.arange(len(size)), size)[:n]
    start = np.flatnonzero(np.arange(n) + width <= edge[1:][owner])
    return start, owner[start]


def _probes(buckets: int):
    def run(batches):
        C.at_work("op7")
        for batch in batches:
            _, h, edge = _read(batch, 1)
            rid = batch.column(0).to_numpy()
            chunk = int(mixed(np.array([rid.view(np.uint64).sum() ^ np.uint64(len(h))], np.uint64) + np.uint64(rid[0]) if len(rid) else np.zeros(1, np.uint64)).view(np.int64)[0])
            rows = [(chunk % buckets, chunk, 1, rid.tobytes(), edge.astype(np.int32).tobytes(), b"")]
            r = rolling(h, BLOCK)
            start, owner = _valid(edge, len(r), BLOCK)
            r = r[start]
            aligned = (start - edge[owner]) % BLOCK == 0
            bucket = ((r >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            key, pos, aligned = r.astype(np.uint32)[order], start[order], aligned[order]
            for b in range(buckets):
                s = slice(at[b], at[b + 1])
                if at[b] < at[b + 1]:
                    step = np.diff(pos[s], prepend=0)
                    step = step.astype("<u2") if int(step.max()) < 65536 else step.astype("<u4")
                    rows.append((b, chunk, 0, key[s].tobytes(), step.tobytes(), np.packbits(aligned[s]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "kind", "a", "b", "c"])

    return run


def _by_first(batches):
    """Rows of batches sorted by their first column, a value of it at a time."""
    now, held = None, []
    for t in batches:
        for first, *row in zip(*(c.to_pylist() for c in t.columns), strict=True):
            if first != now and held:
                yield held
                held = []
            now = first
            held.append(row)
    if held:
        yield held


def _answer(batches):
    """All rows of a bucket: which windows meet a block that is not just their own."""
    for both in _by_first(batches):
        named = [r for r in both if r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in named], pa.int64()), pa.array([1] * len(named), pa.int32()), pa.array([r[2] for r in named], pa.binary()), pa.array([r[3] for r in named], pa.binary())], names=["chunk", "kind", "a", "b"])
        rows = [(chunk, x, y, z) for chunk, kind, x, y, z in both if not kind]
        if not rows:
            continue
        keys = [np.frombuffer(x, "<u4") for _, x, _, _ in rows]
        own = [np.unpackbits(np.frombuffer(z, np.uint8), count=len(k)).astype(bool) for (_, _, _, z), k in zip(rows, keys, strict=True)]
        blocks, times = np.unique(np.concatenate([k[o] for k, o in zip(keys, own, strict=True)]), return_counts=True)
        if not len(blocks):
            continue
        out = []
        for (chunk, _, y, _), k, o in zip(rows, keys, own, strict=True):
            at = np.minimum(np.searchsorted(blocks, k), len(blocks) - 1)
            hit = (blocks[at] == k) & (~o | (times[at] > 1))
            if hit.any():
                pos = np.cumsum(np.frombuffer(y, "<u2" if len(y) == 2 * len(k) else "<u4"), dtype=np.int64)[hit]
                out.append((chunk, pos.astype("<i4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([0] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([b""] * len(out), pa.binary())], names=["chunk", "kind", "a", "b"])


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unions of the intervals [start, end), given by ascending start, as rows (start, end)."""
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return np.stack([start[new], reach[np.concatenate([new[1:] - 1, [len(start) - 1]])]], 1)


def _per_text(batches):
    """For each chunk: the starts of passages around its hits, as intervals, by text."""
    for t in batches:
        ids, spans = [], []
        for parts in t.column(1).to_pylist():
            named = [p for p in parts if p["kind"]]
            hits = [np.frombuffer(p["a"], "<i4") for p in parts if not p["kind"]]
            if not hits or not named:
                continue
            rid, edge = np.frombuffer(named[0]["a"], np.int64), np.frombuffer(named[0]["b"], np.int32)
            pos = np.sort(np.concatenate(hits)).astype(np.int64)
            owner = np.searchsorted(edge, pos, side="right") - 1
            for k in np.unique(owner):
                p = pos[owner == k] - edge[k]
                ids.append(int(rid[k]))
                spans.append(_merged(np.maximum(p - (WINDOW - BLOCK), 0), p + 1).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.binary())], names=["rid", "spans"])


def _later(key: np.ndarray, again: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which passages a smaller doc has among these; passages are the same if both their hashes are."""
    order = np.argsort(key, kind="stable")
    k, a = key[order], again[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    if (~new[1:] & (a[1:] != a[:-1])).any():  # two passages share the first hash
        order = np.lexsort((again, key))
        k, a = key[order], again[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (a[1:] != a[:-1])])
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    late = np.zeros(len(key), bool)
    late[order] = doc[order] > least
    return late


def _passages(buckets: int):
    def run(batches):
        C.at_work("op7")
        for batch in batches:
            _, h, edge = _read(batch, 2)
            r = rolling(h, WINDOW)
            rid, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            pos, owner = [], []
            for k, s in enumerate(batch.column(3).to_pylist()):
                for a, b in np.frombuffer(s, "<i4").reshape(-1, 2).tolist():
                    p = np.arange(a, min(b, int(edge[k + 1] - edge[k]) - WINDOW + 1))
                    pos.append(p)
                    owner.append(np.full(len(p), k))
            if not pos or not len(r):
                continue
            pos, owner = np.concatenate(pos), np.concatenate(owner)
            at = np.minimum(edge[owner] + pos, len(r) - 1)
            key, again = r[at], rolling(h, WINDOW, _SECOND)[at]
            late = _later(key, again, doc[owner])
            rows = []
            if late.any():  # decided here: they only pass through the bucket
                who, times = np.unique(owner[late], return_counts=True)
                rows.append((int(key[0] % np.uint64(buckets)), b"", pos[late].astype("<i4").tobytes(), rid[who].tobytes(), b"", times.astype("<i4").tobytes()))
                key, again, pos, owner = key[~late], again[~late], pos[~late], owner[~late]
            bucket = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(at)).tolist():
                s = order[at[b] : at[b + 1]]
                who, times = np.unique(owner[s], return_counts=True)
                rows.append((b, key[s].tobytes() + again[s].tobytes(), pos[s].astype("<i4").tobytes(), rid[who].tobytes(), doc[who].tobytes(), times.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(6)], names=["bucket", "h", "pos", "rid", "doc", "times"])

    return run


def _earlier(groups: int):
    """All rows of a bucket: the passages that a smaller doc_id has too, packed into one row for each group of texts."""

    def run(batches):
        for rid, pos in _late(batches):
            group = (rid.view(np.uint64) % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((rid, group))
            rid, pos, group = rid[order], pos[order], group[order]
            at = np.searchsorted(group, np.arange(groups + 1))
            rows = []
            for g in np.flatnonzero(np.diff(at)).tolist():
                s = slice(at[g], at[g + 1])
                ids, times = np.unique(rid[s], return_counts=True)
                rows.append((g, ids.tobytes(), times.astype("<i4").tobytes(), pos[s].astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(4)], names=["grp", "rid", "times", "pos"])

    return run


def _late(batches):
    for both in _by_first(batches):
        for r in both:
            if not r[0]:
                yield np.repeat(np.frombuffer(r[2], np.int64), np.frombuffer(r[4], "<i4")), np.frombuffer(r[1], "<i4")
        rows = [r for r in both if r[0]]
        if not rows:
            continue
        times = [np.frombuffer(r[4], "<i4") for r in rows]
        hashes = [np.frombuffer(r[0], np.uint64).reshape(2, -1) for r in rows]
        h, again = np.concatenate([x[0] for x in hashes]), np.concatenate([x[1] for x in hashes])
        doc = np.concatenate([np.repeat(np.frombuffer(r[3], np.int64), n) for r, n in zip(rows, times, strict=True)])
        rid = np.concatenate([np.repeat(np.frombuffer(r[2], np.int64), n) for r, n in zip(rows, times, strict=True)])
        pos = np.concatenate([np.frombuffer(r[1], "<i4") for r in rows])
        late = np.flatnonzero(_later(h, again, doc))
        if len(late):
            yield rid[late], pos[late]


def _removed(batches):
    """All rows of a group of texts: the words under their late passages, as intervals by text."""
    for rows in _by_first(batches):
        rid = np.concatenate([np.repeat(np.frombuffer(r[0], np.int64), np.frombuffer(r[1], "<i4")) for r in rows])
        pos = np.concatenate([np.frombuffer(r[2], "<i4") for r in rows]).astype(np.int64)
        order = np.lexsort((pos, rid))
        rid, pos = rid[order], pos[order]
        ids, at = np.unique(rid, return_index=True)
        spans = [_merged(p, p + WINDOW).astype("<i4").tobytes() for p in np.split(pos, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.binary())], names=["rid", "spans"])


def _cut(batches):
    for batch in batches:
        out = []
        for t, packed in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            words = WORD.findall(t.as_py()) if t.is_valid else []
            spans: list[list[int]] = []
            kept = words
            if packed:
                spans = np.frombuffer(packed, "<i4").reshape(-1, 2).tolist()
                kept, last = [], 0
                for a, b in spans:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
            out.append((len(words), [{"start": a, "end": b} for a, b in spans], b" ".join(kept).decode()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), span, pa.string())))], names=["doc_id", "n_words", "removed", "kept"])


def _joined(texts: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Texts with their spans: broadcast while those are small, else both sides are shuffled."""
    size = spans.agg(F.sum(F.length("spans") + 32)).first()[0] or 0
    return texts.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, "rid", how)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, removed (word intervals, end exclusive) and kept (words joined by a space).

    A word goes when a WINDOW-word passage over it also starts in a document with a smaller doc_id; passages
    are compared on the input, words unchanged. Repeats within one document stay. Null and empty texts have no
    words. A null doc_id counts as larger than any other, and equal to itself. Rows that repeat a doc_id do not
    remove each other's words. Texts shorter than a passage stay whole; a very long one is cut like any other. An
    empty table gives no rows; other columns, whatever their names, do not matter.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 1000)
    text = F.col("text").cast("string")
    slim = docs.select(F.xxhash64("doc_id", text).alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    chars = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(C.partitions(spark), -(-chars // (6 * BUCKET_WINDOWS)))
    probes = slim.select("rid", "text").mapInArrow(_probes(buckets), "bucket int, chunk long, kind int, a binary, b binary, c binary")
    hits, hits_at = C.written(probes.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "chunk long, kind int, a binary, b binary"), "hits")
    C.release(spark)
    chunks = hits.groupBy("chunk").agg(F.collect_list(F.struct("kind", "a", "b")).alias("parts"))
    around, around_at = C.written(chunks.mapInArrow(_per_text, "rid long, spans binary").dropDuplicates(["rid"]), "around")
    found = _joined(slim.select("rid", "doc", "text"), around, "inner").select("rid", "doc", "text", "spans")
    some = max(C.partitions(spark), buckets // 4)
    late = found.mapInArrow(_passages(some), "bucket int, h binary, pos binary, rid binary, doc binary, times binary")
    late = late.repartition(some, "bucket").sortWithinPartitions("bucket").mapInArrow(_earlier(some), "grp int, rid binary, times binary, pos binary")
    removed, _ = C.written(late.repartition(some, "grp").sortWithinPartitions("grp").mapInArrow(_removed, "rid long, spans binary"), "removed")
    C.dropped(spark, hits_at, around_at)
    rows = _joined(slim.select("doc_id", "text", "rid"), removed, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut, "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept string")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(C.load(spark, sf_dir, "documents"))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
