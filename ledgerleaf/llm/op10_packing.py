"""Packing by cutting-stock column generation.

Documents are encoded; every full SEQUENCE of a long document is a sequence of its own, and the rests are
the items of a cutting-stock problem. Their length histogram, which has at most SEQUENCE entries whatever
the corpus, goes to the driver. A linear program over patterns covers it; its duals price new patterns with
a knapsack by dynamic programming until none pays. Rounded-down patterns take documents by their rank
within a length. What rounding leaves, a number that depends on lengths and not on the corpus, is laid end
to end and cut at every sequence.

The program counts in units of UNIT tokens: longer rests are rounded up, shorter ones are bundled, so many
of one length that no unit is wasted.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.llm import common as C
from ledgerleaf.llm.tokens import encoder

SEQUENCE, END_ID, UNIT, SHORT = 2048, 1, 8, 256


def bundle_of(rest: int) -> int:
    """How many rests of one length make an item of the program."""
    if rest >= SHORT:
        return 1
    k = UNIT // math.gcd(rest, UNIT)
    return k * max(1, 64 // (k * rest))


def kind_of(rest: int) -> int:
    """Short rests are kinds of their own; longer ones share a kind with those of the same rounded length."""
    return rest if rest < SHORT else SHORT + -(-rest // UNIT)


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The most valuable multiset of ascending sizes within the capacity: (value, {index: count})."""
    best, pick = np.zeros(capacity + 1), [-1] * (capacity + 1)
    within = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        if k := within[c]:
            total = values[:k] + best[c - sizes[:k]]
            i = int(total.argmax())
            if total[i] > best[c - 1] + 1e-12:
                best[c], pick[c] = total[i], i
                continue
        best[c] = best[c - 1]
    counts: dict[int, int] = {}
    c = capacity
    while c > 0:
        if (i := pick[c]) < 0:
            c -= 1
        else:
            counts[i] = counts.get(i, 0) + 1
            c -= int(sizes[i])
    return float(best[capacity]), counts


def inverted(basis: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps with row pivots. (No threads: a threaded library call can wait for ever beside a session's own.)"""
    m = len(basis)
    work = np.hstack([basis, np.eye(m)])
    for j in range(m):
        pivot = j + int(np.abs(work[j:, j]).argmax())
        if pivot != j:
            work[[j, pivot]] = work[[pivot, j]]
        work[j] /= work[j, j]
        factor = work[:, j].copy()
        factor[j] = 0.0
        work -= factor[:, None] * work[j]
    return work[:, m:]


def column_generation(sizes: list[int], demand: list[int], capacity: int, gap: float = 0.002, rounds: int = 1500) -> list[tuple[dict[int, int], float]]:
    """Patterns ({index: count}) and how often each is used in the linear program, solved to within ``gap`` or for ``rounds`` steps.

    A pattern worth 1 + gap or less at the duals proves that the program's value is within gap of the best.
    """
    m = len(sizes)
    size, need = np.array(sizes), np.array(demand, float)
    patterns: list[dict[int, int]] = [{i: capacity // sizes[i]} for i in range(m)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    use = inverse @ need
    for step in range(rounds):
        if step % 500 == 499:  # against drift
            basis = np.zeros((m, m))
            for j, p in enumerate(patterns):
                basis[list(p), j] = list(p.values())
            inverse = inverted(basis)
            use = np.maximum(inverse @ need, 0)
        value, pattern = knapsack(size, np.maximum(inverse.sum(0), 0), capacity)
        if value <= 1 + gap:
            break
        # (a sum, not a matrix product: it is small, and threads of a BLAS would only get in each other's way)
        direction = (inverse[:, list(pattern)] * np.array(list(pattern.values()), float)).sum(1)
        ratio = np.where(direction > 1e-9, use / np.maximum(direction, 1e-9), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        if not np.isfinite(theta):
            break
        use = np.maximum(use - theta * direction, 0)
        use[out] = theta
        row = inverse[out] / direction[out]
        inverse -= direction[:, None] * row
        inverse[out] = row
        patterns[out] = pattern
    return list(zip(patterns, use.tolist(), strict=True))


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int], int]:
    """Ranges (kind, low, high, first sequence, slot), the items each kind has in them, and the number of sequences.

    Item r of a kind, counted from 0, belongs to the range with low <= r < high and goes to sequence
    ``first + r - low`` at ``slot``; rests beyond a kind's items are left for the end.
    """
    count: dict[int, int] = {}
    size_of: dict[int, int] = {}
    for rest, n in histogram.items():
        kind = kind_of(rest)
        count[kind] = count.get(kind, 0) + n
        size_of[kind] = -(-rest * bundle_of(rest) // UNIT)
    bundle = {k: bundle_of(k) if k < SHORT else 1 for k in count}
    items = {k: count[k] // bundle[k] for k in count}
    by_size: dict[int, list[int]] = {}
    for k in sorted(items):
        if items[k]:
            by_size.setdefault(size_of[k], []).append(k)
    sizes = sorted(by_size)
    taken = dict.fromkeys(items, 0)
    if not sizes:
        return [], taken, 0
    demand = [sum(items[k] for k in by_size[s]) for s in sizes]
    left, out, sequences = list(demand), [], 0
    for pattern, use in sorted(column_generation(sizes, demand, sequence // UNIT), key=lambda x: -x[1]):
        n = min([int(use + 1e-6), *(left[i] // k for i, k in pattern.items())])
        slot = 0
        for i, k in sorted(pattern.items(), reverse=True) if n > 0 else ():
            left[i] -= n * k
            for _ in range(k):
                first, still = sequences, n
                for kind in by_size[sizes[i]]:
                    if part := min(still, items[kind] - taken[kind]):
                        out.append((kind, taken[kind], taken[kind] + part, first, slot))
                        taken[kind] += part
                        first, still = first + part, still - part
                slot += 1
        sequences += max(n, 0)
    return out, taken, sequences


def _encode(path: str, end_id: int, sequence: int):
    def run(batches):
        C.at_work("op10")
        from pyspark import TaskContext

        part, row, full = TaskContext.get().partitionId(), 0, 0
        ranks: dict[int, int] = {}
        end = np.array([end_id], "<u4").tobytes()
        width = 2 if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            cols = ([], [], [], [], [], [])
            found = encoder(path).encode_batch(batch.column(1).to_pylist())
            for ids in found:
                n = len(ids) // 4 + 1
                rest = n % sequence
                kind = kind_of(rest)
                for col, x in zip(cols, (row, n, rest, kind, ranks.get(kind, 0), full), strict=True):
                    col.append(x)
                ranks[kind] = ranks.get(kind, 0) + 1
                row += 1
                full += n // sequence
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            arrays = [pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]
            edge = np.concatenate([[0], np.cumsum(np.array(cols[1], np.int64) * width)]).astype("<i4")
            data = np.frombuffer(end.join([*found, b""]), "<u4").astype(f"<u{width}")
            ids = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(edge), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(batch), pa.int32()), *arrays, ids], names=["doc_id", "part", "row", "doc_tokens", "rest", "kind", "rank", "full", "ids"])
        C.rested()

    return run


#: ``ids`` are little-endian unsigned integers of 2 bytes each, or of 4 where the vocabulary needs them.
ENCODED = "doc_id long, part int, row long, doc_tokens long, rest int, kind int, rank long, full long, ids binary"


def _unpacked(batches):
    for batch in batches:
        ids, edge = _flat(batch)
        arrays = [*batch.columns[:3], pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(ids.astype(np.int32))), *batch.columns[4:]]
        yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)


def _flat(batch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of pieces as unsigned 32-bit integers, and where each piece's begin and end."""
    edge = np.concatenate([[0], np.cumsum(batch.column(2).to_numpy())]).astype(np.int64)
    if pa.types.is_list(batch.schema.field(3).type):
        return batch.column(3).flatten().to_numpy(zero_copy_only=False).astype("<u4"), edge
    raw = b"".join(batch.column(3).to_pylist())
    return np.frombuffer(raw, f"<u{len(raw) // max(1, int(edge[-1]))}" if raw else "<u4").astype("<u4"), edge


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, raw: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids (array<int>; ``raw``: as in ENCODED), doc_tokens, sequence_id, offset.

    Whole texts are encoded and followed by the end id; a null or empty text is the end id alone. Each id lies
    in exactly one piece. Long documents are cut after every ``sequence`` ids; of the rests only those that the
    patterns leave may be cut, at a sequence's end. Sequence ids are unique but not gapless. Rows with null
    or repeated doc_ids, and rows that repeat, are each packed by themselves; ties in length go by file and row.
    A very long text is cut into as many sequences as it fills. An empty table gives no pieces. Other columns,
    whatever their names, do not matter.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 2000)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_of().alias("text"))
    rows, _ = C.written(slim.mapInArrow(_encode(tokenizer, end_id, sequence), ENCODED), "encoded", "lz4")
    # The histogram has at most SEQUENCE rows whatever the corpus, and so has the plan a bounded number of ranges.
    histogram = {r["rest"]: r["n"] for r in rows.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    ranges, taken, sequences = plan(histogram, sequence)
    table = spark.createDataFrame(ranges or [(-1, 0, 0, 0, 0)], "kind int, low long, high long, first long, slot int")
    kinds = spark.createDataFrame([(k, bundle_of(k) if k < SHORT else 1, n) for k, n in taken.items()] or [(-1, 1, 0)], "kind int, bundle int, items long")
    # Ranks run on from file to file: a row for each file and kind carries how many came before.
    counts = rows.groupBy("kind", "part").agg(F.count("*").alias("n"), F.sum(F.expr(f"doc_tokens div {sequence}")).alias("f"))
    before = counts.select("kind", "part", (F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n")).alias("ranked"))
    fulls = counts.groupBy("part").agg(F.sum("f").alias("f")).select("part", (F.sum("f").over(Window.orderBy("part")) - F.col("f")).alias("fulls"))
    items = rows.where("rest > 0").select("part", "row", "kind", "rank", "rest").join(before, ["kind", "part"])
    items = items.join(F.broadcast(kinds), "kind").select("part", "row", "kind", "rest", (F.col("rank") + F.col("ranked")).alias("rank"), "bundle", "items")
    items = items.withColumn("item", F.expr("rank div bundle"))
    placed = items.where("item < items").join(F.broadcast(table), "kind").where("item >= low and item < high")
    placed = placed.select("part", "row", "rank", "rest", (F.col("first") + F.col("item") - F.col("low")).alias("sequence_id"), "slot")
    ahead = F.sum("rest").over(Window.partitionBy("sequence_id").orderBy("slot", "rank").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.select("part", "row", "sequence_id", F.coalesce(ahead, F.lit(0)).cast("long").alias("offset"))
    # What the patterns leave: fewer than a pattern's items for each pattern, and a bundle for each kind.
    over = items.where("item >= items").select("part", "row", F.sum("rest").over(Window.orderBy(F.desc("kind"), "rank", "part", "row").rowsBetween(Window.unboundedPreceding, -1)).alias("at"))
    over = over.select("part", "row", F.coalesce("at", F.lit(0)).alias("at"))
    over = over.select("part", "row", (sequences + F.expr(f"at div {sequence}")).alias("sequence_id"), (F.col("at") % sequence).alias("offset"))
    n_over = sum(histogram.values()) - sum(n * (bundle_of(k) if k < SHORT else 1) for k, n in taken.items())
    tokens_over = n_over * sequence  # an upper bound; ids of whole sequences follow
    base = sequences + tokens_over // sequence + 1
    # fulls has two numbers for each written file: a proven bound. The ids are shuffled once, to meet their places.
    whole = rows.join(F.broadcast(fulls), "part").join(placed.unionByName(over), ["part", "row"], "left")
    full = F.transform(
        F.expr(f"sequence(0L, doc_tokens div {sequence})"),
        lambda i: F.struct((i * sequence).alias("start"), F.lit(sequence).cast("long").alias("length"), (base + F.col("fulls") + F.col("full") + i).alias("sequence_id"), F.lit(0).cast("long").alias("offset")),
    )
    start, fit = F.col("doc_tokens") - F.col("rest"), F.least(F.col("rest").cast("long"), sequence - F.col("offset"))
    first = F.struct(start.alias("start"), fit.alias("length"), F.col("sequence_id"), F.col("offset"))
    second = F.struct((start + fit).alias("start"), (F.col("rest") - fit).alias("length"), (F.col("sequence_id") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    all_pieces = F.concat(F.slice(full, F.lit(1), F.expr(f"cast(doc_tokens div {sequence} as int)")), F.when(F.col("rest") > 0, F.array(first, second)).otherwise(F.array()))
    pieces = whole.select("doc_id", "doc_tokens", "ids", F.explode(F.filter(all_pieces, lambda p: p["length"] > 0)).alias("p"))
    width = F.expr("length(ids) div doc_tokens")
    ids = F.expr("substring(ids, cast(p.start * w + 1 as int), cast(p.length * w as int))")
    pieces = pieces.withColumn("w", width).select("doc_id", "p.start", "p.length", ids.alias("ids"), "doc_tokens", "p.sequence_id", "p.offset")
    return pieces if raw else pieces.mapInArrow(_unpacked, PIECES)


PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def _digest(batches):
    for batch in batches:
        ids, edge = _flat(batch)
        raw, at = memoryview(ids.view(np.uint8)), edge.tolist()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64()), *batch.columns[4:]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.mapInArrow(_digest, DIGEST)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(C.load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), raw=True))
