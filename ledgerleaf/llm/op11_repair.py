"""Conversation structure repair by cost layers, as in approximate matching with bitsets.

The turns of a conversation shall read ``(s?(ua)+)?`` in the initials of their roles. A row may be kept, get the
role user or assistant, or go; a turn without text may be put before any row. For each cost, from 0 on, a bitset of
the grammar's states stands at each turn: the states from which this cost leads to an accepted end. The first layer
whose start state is set gives the cost, and a walk along set bits, least initial first, gives the least audit.

Conversations are cut into blocks of at most ``BLOCK`` rows, so one of any length spreads over tasks: a block's layers
give its costs from each state to each state (a nibble of the bitset for each state it may end in), only these small
tables meet for a conversation, and each block walks by itself.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import common as C

#: Rows of a block; a power of two.
BLOCK = 128
#: What white space is; other characters are a turn's content.
BLANK = " \t\n\x0b\f\r"
#: States: 0 start, 1 after the system turn, 2 after user, 3 after assistant. Edits that end a conversation there.
TAIL = ("", "II", "I", "")
TAIL_COST = tuple(2 * len(t) for t in TAIL)
#: A row's code is 4 * fault + class: no fault, truncated, blank, duplicate; s, u, a, any other initial.
CODES = "sua.SUA;01234567"
BLANKS, DUPLICATES, TRUNCATED = set(CODES[8:12]), set(CODES[12:]), set(CODES[4:8])
LEGAL = {"su", "ua", "au"}
ROLES = ("user", "user", "assistant", "user")  # the role that a state lets follow, system apart
NEXT = (2, 2, 3, 2)  # and the state after it


def _forced(x: int) -> int:
    """The states, in each nibble, whose forced turn leads into ``x``."""
    user, assistant = x & 0x4444, x & 0x8888
    return user >> 2 | user >> 1 | user << 1 | assistant >> 1


def _kept(x: int, kind: int) -> int:
    """The states from which a kept row of this class leads into ``x``."""
    if kind == 0:
        return (x & 0x2222) >> 1
    if kind == 1:
        user = x & 0x4444
        return user >> 2 | user >> 1 | user << 1
    return (x & 0x8888) >> 1 if kind == 2 else 0


def layers(codes: str) -> list[array]:
    """For each cost the bitsets before each row and at the end: bit 4 * exit + state, reached at exactly this cost.

    Deleting all rows costs 3 each and rerouting through inserted turns at most 4 more, so no cheapest way is dearer.
    """
    return _remembered(codes) if len(codes) <= 16 else _layers(codes)


def _layers(codes: str) -> list[array]:
    n = len(codes)
    rows = [(c not in "01234567", int(c in TRUNCATED), CODES.index(c) % 4) for c in codes]
    found: list[array] = []
    for cost in range(3 * n + 5):
        now = [0] * n + [0x8421 if cost == 0 else 0]
        two, three = (found[cost - k] if cost >= k else None for k in (2, 3))
        for j in range(n - 1, -1, -1):
            stays, late, kind = rows[j]
            x = 0
            if two:
                x |= _forced(two[j])
            if three:
                x |= three[j + 1]
            if stays:
                if cost >= late:
                    x |= _kept(found[cost - late][j + 1] if late else now[j + 1], kind)
                if cost >= 2 + late:
                    x |= _forced(found[cost - 2 - late][j + 1])
            now[j] = x
        found.append(array("H", now))
    return found


#: Short conversations repeat, and their layers take some two kilobytes at most.
_remembered = lru_cache(4096)(_layers)
C.forgets.append(_remembered.cache_clear)


def costs(codes: str) -> list[list[int | None]]:
    """The least cost from each state before the block to each state after it."""
    out: list[list[int | None]] = [[None] * 4 for _ in range(4)]
    for cost, layer in enumerate(layers(codes)):
        for state in range(4):
            for end in range(4):
                if out[state][end] is None and layer[0] >> (4 * end + state) & 1:
                    out[state][end] = cost
    return out


def walk(codes: str, found: list[array], state: int, ends: list[int]) -> tuple[int, str]:
    """The state after the block and the least audit, where state s after it costs ``ends[s]`` more."""

    def least(at: int, now: int) -> int:
        return min((c + ends[e] for c, layer in enumerate(found) for e in range(4) if layer[at] >> (4 * e + now) & 1), default=1 << 60)

    def leads(at: int, now: int, rest: int) -> bool:
        return any(0 <= rest - ends[e] < len(found) and found[rest - ends[e]][at] >> (4 * e + now) & 1 for e in range(4))

    rest, j, out = least(0, state), 0, []
    while j < len(codes):
        stays, late, kind = codes[j] not in "01234567", int(codes[j] in TRUNCATED), CODES.index(codes[j]) % 4
        kept = 1 if kind == 0 and state == 0 else 2 if kind == 1 and state != 2 else 3 if kind == 2 and state == 2 else None
        if leads(j + 1, state, rest - 3):
            rest, j = rest - 3, j + 1
            out.append("D")
        elif leads(j, NEXT[state], rest - 2):
            rest, state = rest - 2, NEXT[state]
            out.append("I")
        elif stays and kept is not None and leads(j + 1, kept, rest - late):
            rest, j, state = rest - late, j + 1, kept
            out.append("K")
        else:
            rest, j, state = rest - 2 - late, j + 1, NEXT[state]
            out.append("R")
    return state, "".join(out)


def cleaned(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, null roles and texts as one space; other columns stay behind."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the columns of their order in a conversation: turn (nulls first), role, two hashes of role and text."""
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})


ORDER = ["turn", "role", "h1", "h2"]


def _slim(rows: DataFrame) -> DataFrame:
    """Each row without its text, its place in the order of all rows, and its fault's first part."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    fault = F.when(trimmed == "", 2).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    slim = _keyed(rows).select("conv_id", *ORDER, fault.alias("fault"), kind.alias("kind"), F.monotonically_increasing_id().alias("mid"))
    spark = rows.sparkSession
    parts = max(C.partitions(spark), spark.sparkContext.defaultParallelism)
    # The last key tells repeats of one row apart, which are alike in all that counts: they too spread over tasks.
    ranged = slim.repartitionByRange(parts, "conv_id", *ORDER, "mid").sortWithinPartitions("conv_id", *ORDER, "mid")
    return ranged.select("conv_id", "turn", "h1", "h2", "fault", "kind", F.monotonically_increasing_id().alias("pos"))


def _blocks(slim: DataFrame) -> DataFrame:
    """conv_id, block, codes and the turns' least, greatest and distinct number, of at most BLOCK rows each."""
    live = slim.where("fault != 2")
    # One row for a text that a conversation repeats, made within the tasks first; a join, which Spark may split, for the rest.
    first = live.groupBy("conv_id", "h1", "h2").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("h1").alias("a"), F.col("h2").alias("b"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))
    marked = slim.join(first, same & (F.col("fault") != 2) & (F.col("pos") > F.col("first")), "left")
    code = F.expr(f"substring('{CODES}', 4 * IF(first IS NULL, fault, 3) + kind + 1, 1)")
    grouped = marked.withColumn("code", code).groupBy("conv_id", F.shiftright("pos", BLOCK.bit_length() - 1).alias("block"))
    return grouped.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"),
    )


def _block_costs(batches):
    C.at_work("op11")
    for batch in batches:
        flat = [[-1 if c is None else c for row in costs(x) for c in row] for x in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat, pa.list_(pa.int64()))], names=[*batch.schema.names, "costs"])


def _ends(batches):
    """For each conversation's blocks, what each state after the block costs until the end; from the last block back."""
    C.at_work("op11")
    for batch in batches:
        out = []
        for blocks in batch.column("blocks").to_pylist():
            after = list(TAIL_COST)
            made = []
            for b in reversed(blocks):
                made.append({"block": b["block"], "codes": b["codes"], "ends": after, "last": not made})
                flat = b["costs"]
                after = [min((flat[4 * s + e] + after[e] for e in range(4) if flat[4 * s + e] >= 0), default=1 << 50) for s in range(4)]
            out.append(made)
        kind = pa.list_(pa.struct([("block", pa.int64()), ("codes", pa.string()), ("ends", pa.list_(pa.int64())), ("last", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, kind)], names=["conv_id", "blocks"])


def _walks(batches):
    C.at_work("op11")
    for batch in batches:
        out = []
        for codes, ends in zip(batch.column("codes").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            found = layers(codes)
            out.append([{"state": s, "audit": a} for s, a in (walk(codes, found, q, ends) for q in range(4))])
        kind = pa.list_(pa.struct([("state", pa.int32()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "walks"])


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _reports(batches):
    C.at_work("op11")
    names = [c.split()[0] for c in REPORT.split(", ")]
    for batch in batches:
        out = []
        for conv, blocks in zip(batch.column("conv_id").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
            state, audit, codes, cost = 0, [], [], 0
            low = high = None
            distinct = 0
            for b in blocks:
                state, part = b["walks"][state]["state"], b["walks"][state]["audit"]
                audit.append(part)
                codes.append(b["codes"])
                if b["low"] is not None:
                    distinct += b["turns"] - (high == b["low"])  # a turn on both sides of a cut
                    low, high = b["low"] if low is None else low, b["high"]
            text, steps = "".join(codes), "".join(audit) + TAIL[state]
            at = 0
            for e in steps:
                cost += {"K": 0, "R": 2, "D": 3, "I": 2}[e] + (e in "KR" and text[at] in TRUNCATED)
                at += e != "I"
            kinds = "".join("sua."[CODES.index(c) % 4] for c in text)
            illegal = sum(kinds[i : i + 2] not in LEGAL for i in range(len(kinds) - 1))
            gaps = 0 if low is None else high - low + 1 - distinct
            out.append((conv, gaps, *(sum(c in s for c in text) for s in (BLANKS, DUPLICATES, TRUNCATED)), illegal, cost, steps))
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)


def repair_plan(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """For each conversation its faults, the least cost of a repair, and the least of the cheapest audits.

    Rows are taken by turn, nulls first; of equal turns by role, then by hashes of role and text. A null conv_id is one
    conversation; null roles and texts count as one space. Conversations that only ``ids`` has get zeros and an empty
    audit, an empty table none. Very long texts count like others (tasks see their hashes alone), and very long
    conversations are repaired block by block; an audit is one value, so a conversation has at most 2^31 rows. Repeated
    rows are duplicates beyond the first. Further columns, whatever their names, do not matter.
    """
    spark = turns.sparkSession
    C.shipped(spark)
    slim, at = C.written(_slim(cleaned(turns)), "turns")
    C.release(spark)
    blocks, blocks_at = C.written(_blocks(slim), "turn-blocks")
    C.dropped(spark, at)
    names = "conv_id long, block long, codes string, low long, high long, turns long"
    solved = blocks.select("conv_id", "block", "codes", "low", "high", "turns").mapInArrow(_block_costs, names + ", costs array<long>")
    as_list = lambda *c: F.array_sort(F.collect_list(F.struct(*c))).alias("blocks")
    ends = solved.groupBy("conv_id").agg(as_list("block", "codes", "costs"))
    ends = ends.mapInArrow(_ends, "conv_id long, blocks array<struct<block:long,codes:string,ends:array<long>,last:boolean>>")
    walks = ends.select("conv_id", F.inline("blocks")).mapInArrow(
        _walks, "conv_id long, block long, codes string, ends array<long>, last boolean, walks array<struct<state:int,audit:string>>"
    )
    # Blocks meet their turns' extent again by conversation and block; conversations without rows add one row without a block.
    extent = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "low", "high", "turns")
    met = walks.join(extent, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    met = met.select("conv_id", "block", "codes", "low", "high", "turns", "walks")
    if ids is not None:
        none = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        met = met.unionByName(none, allowMissingColumns=True)
    kept = F.when(F.col("block").isNotNull(), F.struct("block", "codes", "low", "high", "turns", "walks"))
    return met.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("blocks")).mapInArrow(_reports, REPORT)


def _edited(batches, digests: bool):
    """Rows by conversation, its report before its turns: the repaired turns, or a digest of them, as they stream by."""
    C.at_work("op11")
    names = ["conv_id", "audit", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    head, at, place, state, sha = None, 0, 0, 0, None
    rows: list[tuple] = []

    def emit(role: str, text: str) -> None:
        nonlocal place
        if digests:
            sha.update((b"\n" if place else b"") + f"{role}:{text}".encode())
        else:
            rows.append((head[0], place, role, text))
        place += 1

    def inserts() -> None:
        nonlocal at, state
        while at < len(head[1]) and head[1][at] == "I":
            emit(ROLES[state], "")
            at, state = at + 1, NEXT[state]

    def close() -> None:
        if head is not None:
            inserts()
            if digests:
                rows.append((head[0], *head[4:], head[1], sha.hexdigest()))

    def flush():
        kinds = [pa.int64()] * 7 + [pa.string()] * 2 if digests else [pa.int64()] * 2 + [pa.string()] * 2
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        out = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] if digests else ["conv_id", "place", "role", "text"]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=out)
        rows.clear()
        return made

    for batch in batches:
        for r in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if r[1] is not None:  # a report
                close()
                head, at, place, state, sha = r, 0, 0, 0, hashlib.sha256()
                continue
            inserts()
            edit = head[1][at]
            at += 1
            if edit == "K":
                emit(r[2], r[3])
                state = 1 if r[2][:1] == "s" else 2 if r[2][:1] == "u" else 3
            elif edit == "R":
                emit(ROLES[state], r[3])
                state = NEXT[state]
        yield flush()
    close()
    yield flush()


def _streams(turns: DataFrame, plan: DataFrame, digests: bool, schema: str) -> DataFrame:
    spark = turns.sparkSession
    C.small_batches(spark, 1000)
    texts = _keyed(cleaned(turns)).withColumn("kind", F.lit(1))
    both = plan.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    sorted_ = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    slim = sorted_.select("conv_id", "audit", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return slim.mapInArrow(lambda batches: _edited(batches, digests), schema)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), role and text. What ``repair_plan`` states holds here too."""
    return _streams(turns, repair_plan(turns), False, "conv_id long, place long, role string, text string")


def repair_report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``repair_plan`` with repaired_sha256, the digest of the repaired ``role:text`` lines, for each conversation.

    A digest runs over a whole conversation in its order, so its rows stream through one task, held by none.
    """
    return _streams(turns, repair_plan(turns, ids), True, REPORT + ", repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = cleaned(turns).withColumn("hit", hit).where("hit != 0")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("again")).drop("again")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(turns), turns)
