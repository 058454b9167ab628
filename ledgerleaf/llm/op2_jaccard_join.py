"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Two sets link when their Jaccard similarity is at
least ``percent`` of a hundred. Sets are dealt into size bands; for each band the largest Hamming distance
of a linked pair is known, the feature domain is cut into enough first-level partitions that some of them
hold at most K2 differences, each of those into N2 parts, and every subset of N2 - K2 parts gives a
signature. Linked sets of a band so share a signature; shared signatures are checked exactly.

Signatures of an empty subset say nothing, and would bring together sets that have nothing in common, so there are
none. Of ``n1`` partitions at least ``n1 - k // (K2 + 1)``, the spare ones, differ by at most one feature. If such a
partition's agreeing subset is empty, all that both sets have in it lies in the part left out, and one set has at most
one feature more: a set gives the part's content, and its content without each single feature. Only where one has
nothing in the partition, and the other at most one feature, do they still miss each other. A pair that misses in all
spare partitions has them among its bare ones, so a set with so many gives the first of them, all but the spare ones
less one, and no link is lost.

One document of each distinct text takes part. Signatures travel once, packed by buckets, and only those with
several holders become rows. Then:

1. Each group of holders is led by the one that shares most signatures: near copies lie nearer to a central
   text than to each other. Every holder is checked against the leader that it shares most signatures with.
2. Groups whose holders now lie in different components go on. The holders outside the leader's component meet
   that component's holders, for all groups of the component together, and group by group they meet each
   other; both in blocks of BLOCK, first by parity bitmaps, which bound the Hamming distance from below, then
   those that may be near, over any number of steps, by their features. A block keeps its own components, so that
   it emits a linked pair only where two of them meet.

Two sets that share a signature are so either in one component or compared; pairs within a component are not
formed. No step has more rows than holders times blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import common as C
from ledgerleaf.llm.components import components, forest
from ledgerleaf.llm.words import LOWER, WORD, mixed, shingles

K2, N2 = 1, 3
#: Ids broadcast for semi joins: at most so many rows of a few numbers; beyond, Spark shuffles both sides.
BROADCAST_IDS = 500_000
#: Holders that are compared at once, and members of a leader that one task checks.
BLOCK, MEMBERS = 256, 2000
#: Signatures that a task gathers before it packs them.
PACK = 1 << 19


def bands(percent: int, top: int = 1 << 40) -> list[tuple[int, int]]:
    """Size bands [low, high]; their ratio trades signatures of two bands against wider distances."""
    ratio, out, low = (125 if percent >= 90 else 150), [], 1
    while low < top:
        high = max(low, low * ratio // 100)
        out.append((low, high))
        low = high + 1
    return out


def distance(percent: int, high: int) -> int:
    """The largest Hamming distance of a linked pair whose larger set has at most ``high`` features."""
    return 2 * high * (100 - percent) // (100 + percent)


def signatures(features: np.ndarray, percent: int, band_list: list[tuple[int, int]]) -> np.ndarray:
    """The PartEnum signatures of one ascending set, for its own band and for those above in which a linked set can lie.

    Features are uniform hashes, so the parts are equal ranges of their domain: each is a run of the set.
    """
    size, out = len(features), []
    if not size:
        return np.empty(0, np.uint64)
    i = int(np.searchsorted([b[0] for b in band_list], size, side="right")) - 1
    for band in range(i, len(band_list)):
        low, high = band_list[band]
        if size * 100 < percent * low:
            break
        k = distance(percent, high)
        tag = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        if k == 0:
            out.append(mixed(np.array([features.sum(dtype=np.uint64)]) ^ tag))
            continue
        needed = k // (K2 + 1)
        spare = 1 + needed // 12
        n1 = needed + spare
        parts = n1 * N2
        slot = ((features >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(slot, minlength=parts)
        edge = np.concatenate([[0], np.cumsum(count)])
        value = mixed(features ^ tag)
        run = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
        total = (run[edge[1:]] - run[edge[:-1]]).reshape(n1, N2)
        count = count.reshape(n1, N2)
        whole, held = total.sum(1, dtype=np.uint64), count.sum(1)
        place = np.arange(parts, dtype=np.uint64)
        some = held[:, None] > count  # each subset leaves one part out
        out.append(mixed((whole[:, None] - total)[some] ^ mixed(place.reshape(n1, N2)[some] + tag)))
        alone = (~some & (count > 0)).ravel()
        if alone.any():
            at = np.flatnonzero(alone)
            out.append(mixed(whole[at // N2] ^ mixed(place[at] + ~tag)))
            each = alone[slot] & (held[slot // N2] > 1)
            at = slot[each]
            out.append(mixed((whole[at // N2] - value[each]) ^ mixed(place[at] + ~tag)))
        bare = np.flatnonzero(held < 2)
        if len(bare) >= spare:
            out.append(mixed(place[bare[: len(bare) - spare + 1]] + (tag ^ np.uint64(0x5555555555555555))))
    return np.concatenate(out)


def bitmap(features: np.ndarray) -> bytes:
    """Parities of feature counts in a power of two of cells, twice the set's size or more; differing bits bound the distance."""
    cells = 128
    while cells < 2 * len(features):
        cells *= 2
    counts = np.bincount((features >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(counts.astype(np.uint8)).tobytes()


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A finer bitmap folds onto a coarser one."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 8 > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def far_apart(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """True only if the bitmaps prove that the sets are not linked."""
    width = min(len(a), len(b))
    apart = int(np.bitwise_count(_folded(a, width) ^ _folded(b, width)).sum())
    return apart * (100 + percent) > (na + nb) * (100 - percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: both are ascending sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _words(text) -> list[bytes]:
    return WORD.findall(text.as_py().translate(LOWER)) if text.is_valid else []


SCANNED = "bucket int, doc_id long, h1 long, h2 long, node long, n_shingles long, bits binary, blob binary"
NAMES = ["bucket", "doc_id", "h1", "h2", "node", "n_shingles", "bits", "blob"]


def _scan(width: int, percent: int, buckets: int):
    """A row for each document, and packed signatures by bucket: (node, 32 bits of the signature) for each.

    A node is numbered by task and row, which a repeated task does alike.
    """
    band_list = bands(percent)

    def packed(base: int, nodes: list[int], sigs: list[np.ndarray]):
        if not nodes:
            return None
        flat = np.concatenate(sigs)
        owner = np.repeat(np.array(nodes, np.int64) - base, [len(s) for s in sigs]).astype("<u4")
        bucket = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        short, owner = flat.astype("<u4")[order], owner[order]
        found, at = np.unique(bucket[order], return_index=True)
        head = np.array([base], "<i8").tobytes()
        edge = [*at.tolist(), len(order)]
        blobs = [head + short[a:z].tobytes() + owner[a:z].astype("<u2").tobytes() for a, z in zip(edge, edge[1:], strict=False)]
        nulls = [pa.nulls(len(blobs), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *nulls, pa.array(blobs, pa.binary())], names=NAMES)

    def run(batches):
        C.at_work("op2")
        from pyspark import TaskContext

        row = base = TaskContext.get().partitionId() << 33
        nodes, sigs, held = [], [], 0
        for batch in batches:
            ids, n, bits, first = batch.column(0).to_pylist(), [], [], row
            for i, text in zip(ids, batch.column(1).cast(pa.binary()), strict=True):
                f = shingles(_words(text), width)
                n.append(len(f))
                bits.append(bitmap(f) if len(f) else None)
                if i is not None and len(f):
                    s = signatures(f, percent, band_list)
                    nodes.append(row)
                    sigs.append(s)
                    held += len(s)
                row += 1
            size = len(ids)
            own = np.arange(first, row)
            spread = pa.array((own % buckets).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([spread, batch.column(0), batch.column(2), batch.column(3), pa.array(own, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(size, pa.binary())], names=NAMES)
            if held >= PACK or row - base >= 60_000:
                if (out := packed(base, nodes, sigs)) is not None:
                    yield out
                nodes, sigs, held, base = [], [], 0, row
        if (out := packed(base, nodes, sigs)) is not None:
            yield out
        C.rested()

    return run


HELD = "doc_id long, h1 long, h2 long, node long, n_shingles long, bits binary, grp long, sigs long"
HELD_NAMES = [*NAMES[1:7], "grp", "sigs"]


def _match(batches):
    """Documents' rows pass; of the packed signatures those with several holders become rows (node, grp).

    A group is named by a sum over its holders, so groups of the same holders are one.
    """
    short, node = [], []
    for batch in batches:
        blobs = batch.column(7)
        docs = batch.filter(blobs.is_null())
        if len(docs):
            yield pa.RecordBatch.from_arrays([*docs.columns[1:7], *[pa.nulls(len(docs), pa.int64())] * 2], names=HELD_NAMES)
        for bucket, blob in zip(batch.column(0).to_pylist(), blobs.to_pylist(), strict=True):
            if blob is not None:
                n = (len(blob) - 8) // 6
                base = int(np.frombuffer(blob, "<i8", 1)[0])
                short.append(np.uint64(bucket << 32) | np.frombuffer(blob, "<u4", n, 8).astype(np.uint64))
                node.append(base + np.frombuffer(blob, "<u2", n, 8 + 4 * n).astype(np.int64))
    if not short:
        return
    short, node = np.concatenate(short), np.concatenate(node)
    order = np.argsort(short, kind="stable")
    short = short[order]
    shared = np.zeros(len(short), bool)
    same = short[1:] == short[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    short, node = short[shared], node[order][shared]
    if not len(short):
        return
    order = np.lexsort((node, short))
    short, node = short[order], node[order]
    fresh = np.concatenate([[True], (short[1:] != short[:-1]) | (node[1:] != node[:-1])])
    short, node = short[fresh], node[fresh]
    start = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
    count = np.diff(np.concatenate([start, [len(short)]]))
    name = np.add.reduceat(mixed(node.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), start)
    # of the groups in this bucket that have the same holders, one, with the number of its signatures
    several = np.flatnonzero(count > 1)
    _, first, times = np.unique(name[several], return_index=True, return_counts=True)
    sigs = np.zeros(len(start), np.int64)
    sigs[several[first]] = times
    rows = np.repeat(sigs > 0, count)
    node, name, sigs = node[rows], np.repeat(name, count)[rows].view(np.int64), np.repeat(sigs, count)[rows]
    for i in range(0, len(node), 100_000):
        z = slice(i, i + 100_000)
        n = len(node[z])
        nulls = [pa.nulls(n, pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([*nulls, pa.array(node[z]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(name[z]), pa.array(sigs[z])], names=HELD_NAMES)


def _features(width: int):
    def run(batches):
        C.at_work("op2")
        for batch in batches:
            out = [shingles(_words(t), width).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "features"])

    return run


def _grouped(batches, keys: int):
    """Rows of sorted batches, key by key: (key, columns as lists)."""
    now, held = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def _led(percent: int, exact: bool):
    """Of (leader, part) groups sorted so that the leader comes first: the members that may be, or are, linked with it."""

    def run(batches):
        a, b = [], []
        for (leader, _), rows in _grouped(batches, 2):
            _, _, size, load = rows[0]
            mine = np.frombuffer(load, np.uint64) if exact else load
            for is_member, node, n, other in rows:
                if is_member and (linked(mine, np.frombuffer(other, np.uint64), percent) if exact else not far_apart(mine, other, size, n, percent)):
                    a.append(leader)
                    b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _near_masks(rows: list[tuple], percent: int):
    """(outside, others, matrix of those that may be near); rows are (side, node, comp, n, bits, ...), side 0: outside, 1: other, 2: both."""
    outs, others = [r for r in rows if r[0] != 1], [r for r in rows if r[0]]
    if not outs or not others:
        return None
    size = [np.array([r[3] for r in side], np.int64) for side in (outs, others)]
    comp = [np.array([r[2] for r in side], np.int64) for side in (outs, others)]
    width = [np.array([len(r[4]) for r in side]) for side in (outs, others)]
    ok = (comp[0][:, None] != comp[1][None]) & (100 * np.minimum(size[0][:, None], size[1][None]) >= percent * np.maximum(size[0][:, None], size[1][None]))
    # Bitmaps of the same width, or of two, at a time: a fold to the narrowest of a block would say little of large sets.
    for w in np.unique(width[0]).tolist():
        for v in np.unique(width[1]).tolist():
            i, j = np.flatnonzero(width[0] == w), np.flatnonzero(width[1] == v)
            spot = np.ix_(i, j)
            if not ok[spot].any():
                continue
            x, y = (np.stack([_folded(side[k][4], min(w, v)) for k in at.tolist()]) for side, at in ((outs, i), (others, j)))
            apart = np.zeros((len(i), len(j)), np.int64)
            for c in range(x.shape[1]):
                apart += np.bitwise_count(x[:, c][:, None] ^ y[:, c][None])
            ok[spot] &= apart * (100 + percent) <= (size[0][i][:, None] + size[1][j][None]) * (100 - percent)
    return outs, others, ok


def _meet(percent: int):
    """Of blocks: pairs (a, b) that span what may be near to a set of another component, by way of others or not."""

    def run(batches):
        a, b = [], []
        for _, rows in _grouped(batches, 4):
            if (found := _near_masks(rows, percent)) is not None:
                outs, others, ok = found
                find, join, _ = forest()
                for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                    x, y = outs[i][1], others[j][1]
                    if find(x) != find(y):
                        join(x, y)
                        a.append(x)
                        b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _join(percent: int):
    """Of blocks: linked pairs that join components, as far as the block can tell."""

    def run(batches):
        a, b = [], []
        for _, rows in _grouped(batches, 4):
            if (found := _near_masks(rows, percent)) is None:
                continue
            outs, others, ok = found
            find, join, _ = forest()
            for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                x, y = outs[i][2], others[j][2]
                if find(x) != find(y) and linked(np.frombuffer(outs[i][5], np.uint64), np.frombuffer(others[j][5], np.uint64), percent):
                    join(x, y)
                    a.append(outs[i][1])
                    b.append(others[j][1])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class _Work:
    """The tables of one join; ``drop`` deletes those of the given tags, or all, when nothing refers to them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
        out, path = C.written(df, tag, codec)
        self.paths.append((tag, path))
        return out

    def drop(self, *tags: str) -> None:
        gone = [(tag, path) for tag, path in self.paths if not tags or tag in tags]
        C.dropped(self.spark, *(path for _, path in gone))
        self.paths = [x for x in self.paths if x not in gone]


def _bounded(small: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast up to BROADCAST_IDS rows of a few numbers; beyond, Spark shuffles both sides."""
    return F.broadcast(small) if (small.count() if rows is None else rows) <= BROADCAST_IDS else small


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, and n_copies, the rows that have the same text.

    Whole texts are lower-cased in A-Z and split at ASCII white space. A null or empty text, or one without
    words, has no shingles, links with nothing and is its own component; fewer words than ``width`` are one
    shingle. A document's component is the smallest doc_id that links lead to, itself included. A row with a
    null doc_id has a null component and links with nothing. Repeated rows stay repeated; rows that repeat a
    doc_id with other texts are judged each by its own text. A very long text is one set like others; a task
    holds at most 2 x BLOCK sets at a time. Other columns, whatever their names, do not matter. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 1000)
    work, parts = _Work(spark), C.partitions(spark)
    text = F.col("text").cast("string")
    # Two hashes together name a text: 128 bits.
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("again"), text).alias("h2"))
    counts = slim.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("n_copies"), F.count("*").alias("n"))
    copied, _ = C.written(counts.where("n > 1").drop("n"), "copied")
    few = copied.count()
    reps = slim.join(_bounded(copied, few), ["h1", "h2"], "left").where("rep is null or rep = doc_id").select("doc_id", "text", "h1", "h2")
    scanned = reps.mapInArrow(_scan(width, percent, parts), SCANNED).repartition(parts, "bucket")
    both = work.keep(scanned.mapInArrow(_match, HELD), "matched")
    C.release(spark)
    sets = both.where("grp is null").drop("grp", "sigs")
    held = work.keep(both.where("grp is not null").groupBy("grp", "node").agg(F.sum("sigs").alias("sigs")), "held")
    degree = held.groupBy("node").agg(F.sum("sigs").alias("degree"))
    degree = work.keep(degree, "degrees")
    n_held = degree.count()
    if not n_held:
        return _labelled(slim, sets, None, copied, few)
    ranked = held.join(_bounded(degree, n_held), "node")
    leaders = ranked.groupBy("grp").agg(F.max(F.struct("degree", "node")).alias("lead"))
    leaders = work.keep(leaders, "leaders")
    member = held.join(leaders, "grp").where("node <> lead.node").groupBy("node", "lead").agg(F.sum("sigs").alias("sigs"))
    member = member.groupBy("node").agg(F.max(F.struct("sigs", "lead")).alias("x"))
    member = work.keep(member.select("node", F.col("x.lead.node").alias("leader")), "members")
    work.drop("degrees")
    info = sets.select("node", "n_shingles", "bits")
    near = work.keep(_check_led(member, info, "bits", percent, parts, exact=False), "near")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    feats = work.keep(_features_of(reps, sets, ends, width), "features", "lz4")
    first = work.keep(_check_led(near.select(F.col("b").alias("node"), F.col("a").alias("leader")), feats.withColumn("n_shingles", F.expr("length(features) div 8")), "features", percent, parts, exact=True), "links")
    comp = work.keep(components(first), "components")
    n_named = comp.count()
    left = work.keep(_open(held, leaders, comp, n_named), "open")
    work.drop("held", "leaders", "members", "near")
    met = work.keep(_blocks(left, info, [], parts).mapInArrow(_meet(percent), "a long, b long").distinct(), "met")
    work.drop("open")
    if not met.isEmpty():
        # What may be near, over any number of steps, is compared together, so that each set's features travel once for each block.
        family = work.keep(components(met), "families")
        n_family = family.count()
        more = family.select("node").join(feats.select("node"), "node", "left_anti")
        more = work.keep(_features_of(reps, sets, more, width), "features", "lz4")
        loads = feats.select("node", "features").unionByName(more)
        again = family.select(F.lit(2).alias("kind"), F.col("component").alias("key"), "node").join(_bounded(comp.select("node", "component"), n_named), "node", "left")
        again = again.select("kind", "key", "node", F.coalesce("component", "node").alias("component"), F.lit(2).alias("side"))
        near_info = info.join(_bounded(family.select("node"), n_family), "node", "left_semi")
        second = _blocks(again, near_info.join(loads, "node"), ["features"], parts).mapInArrow(_join(percent), "a long, b long").distinct()
        second = work.keep(second, "links")
        C.release(spark)
        if not second.isEmpty():
            comp = work.keep(components(first.unionByName(second)), "components")
    return _labelled(slim, sets, comp, copied, few, work)


def _features_of(reps: DataFrame, sets: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, features) of the given nodes: their texts are read once more."""
    ids = sets.join(_bounded(nodes), "node", "left_semi").select("node", "doc_id", "h1", "h2")
    texts = reps.where("doc_id is not null").join(_bounded(ids), ["doc_id", "h1", "h2"]).select("node", "text")
    return texts.mapInArrow(_features(width), "node long, features binary")


def _check_led(member: DataFrame, info: DataFrame, load: str, percent: int, parts: int, exact: bool) -> DataFrame:
    """(a, b): leaders and those of their members that pass; a leader with many members serves several tasks."""
    split = member.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    spread = split.select("leader", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    lead = spread.select("leader", "part", F.lit(0).alias("is_member"), F.col("leader").alias("node"))
    mine = member.join(split, "leader").select("leader", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("is_member"), "node")
    # What is compared is shuffled once, to its leader.
    rows = info.join(_bounded(lead.unionByName(mine)), "node").select("leader", "part", "is_member", "node", "n_shingles", load)
    rows = rows.repartition(parts, "leader", "part").sortWithinPartitions("leader", "part", "is_member")
    return rows.mapInArrow(_led(percent, exact), "a long, b long")


def _open(held: DataFrame, leaders: DataFrame, comp: DataFrame, n_named: int) -> DataFrame:
    """(kind, key, node, component, side) of groups that hold several components.

    Kind 0: under the leader's component, its own holders (side 1) and those outside (side 0), of all groups with such a
    leader. Kind 1: under the group, those outside (side 2), where they are of several components.
    """
    named = comp.select("node", "component")
    small = _bounded(named, n_named)
    placed = held.select("grp", "node").join(small, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keys = leaders.select("grp", F.col("lead.node").alias("node")).join(small, "node", "left").select("grp", F.coalesce("component", "node").alias("key"))
    rows = placed.join(keys, "grp")
    outside = F.when(F.col("component") != F.col("key"), F.col("component"))
    several = rows.groupBy("grp").agg(F.min(outside).alias("low"), F.max(outside).alias("high")).where("low is not null")
    rows = rows.join(several, "grp")
    first = rows.select(F.lit(0).alias("kind"), "key", "node", "component", F.when(F.col("component") == F.col("key"), 1).otherwise(0).alias("side")).distinct()
    second = rows.where("low <> high and component <> key").select(F.lit(1).alias("kind"), F.col("grp").alias("key"), "node", "component", F.lit(2).alias("side"))
    return first.unionByName(second)


def _blocks(left: DataFrame, info: DataFrame, more: list[str], parts: int) -> DataFrame:
    """Blocks (kind, key, x, y): sides 0 and 2 dealt out to x, sides 1 and 2 to y. Rows lie block by block.

    A single block of side 2 has its rows once.
    """
    each = lambda side: F.ceil(F.sum(F.when(F.col("side") != side, 1).otherwise(0)) / BLOCK).cast("int")
    size = left.groupBy("kind", "key").agg(each(1).alias("xs"), each(0).alias("ys")).where("xs > 0 and ys > 0")
    rows = left.join(size, ["kind", "key"]).join(info, "node")
    x, y = (F.pmod(F.xxhash64("node"), F.col(n)).cast("int") for n in ("xs", "ys"))
    place = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.alias("side"))
    outs = F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda i: place(x, i, F.lit(0)))
    others = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda i: place(i, y, F.lit(1)))
    single = F.array(place(F.lit(0), F.lit(0), F.lit(2)))
    spots = F.when(F.col("side") == 0, outs).when(F.col("side") == 1, others).when((F.col("xs") == 1) & (F.col("ys") == 1), single).otherwise(F.concat(outs, others))
    dealt = rows.select("kind", "key", F.explode(spots).alias("p"), "node", "component", "n_shingles", "bits", *more)
    dealt = dealt.select("kind", "key", "p.x", "p.y", "p.side", "node", "component", "n_shingles", "bits", *more)
    return dealt.repartition(parts, "kind", "key", "x", "y").sortWithinPartitions("kind", "key", "x", "y")


def _labelled(slim: DataFrame, sets: DataFrame, comp: DataFrame | None, copied: DataFrame, few: int, work: "_Work | None" = None) -> DataFrame:
    """Back from nodes to rows: a component is called by its smallest doc_id."""
    if comp is None:
        own = sets.select("h1", "h2", "n_shingles", F.col("doc_id").alias("label"), F.lit(False).alias("by_links"))
    else:
        named = comp.join(sets.select("node", "doc_id"), "node")
        least = named.groupBy("component").agg(F.min("doc_id").alias("label"))
        label = named.join(least, "component").select("node", "label")
        own = sets.join(label, "node", "left").select("h1", "h2", "n_shingles", F.coalesce("label", "doc_id").alias("label"), F.col("label").isNotNull().alias("by_links"))
    texts = own.groupBy("h1", "h2").agg(F.max("n_shingles").alias("n_shingles"), F.min("label").alias("label"))
    labels, _ = C.written(texts, "labels")
    if work is not None:
        work.drop()
    rows = slim.select("doc_id", "h1", "h2").join(labels, ["h1", "h2"], "left").join(_bounded(copied.drop("rep"), few), ["h1", "h2"], "left")
    mine = F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), mine).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with its own columns: of each component, and of rows that repeat a doc_id, one row stays.

    The smallest doc_id of a component stays. Rows without words, and rows with a null doc_id, all stay.
    """
    spark = docs.sparkSession
    found, found_at = C.written(jaccard_join(docs, width, percent), "joined")
    gone, _ = C.written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    again, _ = C.written(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    C.dropped(spark, found_at)
    kept = docs.join(_bounded(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    again = _bounded(again)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
