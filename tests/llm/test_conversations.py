"""Conversation repair against a search over all edits, block cuts included."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from ledgerleaf.llm import op11_repair

BLANK = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, cost long, BLOCK string, kind string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def dijkstra(rows):
    """Cheapest edits, least audit of those, by a queue over (cost, audit, place, roles so far's state)."""
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, last, out = heapq.heappop(queue)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        names = {"u": "user", "a": "assistant"}
        for x in steps[last]:
            if x in names:
                heapq.heappush(queue, (cost + 2, audit + "I", at, x, (*out, (names[x], ""))))
        if at < len(rows):
            (role, text), fault = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, last, out))
            if fault in (None, "truncated"):
                late = int(fault == "truncated")
                if role[:1] and role[:1] in steps[last]:
                    heapq.heappush(queue, (cost + late, audit + "K", at + 1, role[:1], (*out, (role, text))))
                for x in steps[last]:
                    if x in names:
                        heapq.heappush(queue, (cost + late + 2, audit + "R", at + 1, x, (*out, (names[x], text))))


def wanted(rows, ids):
    found = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, judged = set(), []
        for _, _, role, text in own:
            trimmed = text.strip(BLANK)
            fault = "blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append(((role, text), fault))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[0][0][:1] + b[0][0][:1] for a, b in zip(judged, judged[1:], strict=False)]
        cost, audit, out = dijkstra(judged) if judged else (0, "", ())
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        count = lambda x: sum(f == x for _, f in judged)  # noqa: E731, B023
        found[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return found


def conversations(seed=3):
    """Distinct turns in each conversation but for null turns, of which a conversation has at most one."""
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        n = rng.choice([1, 2, 3, 5, 8]) if conv != 7 else 700
        turns = rng.sample(range(-2, 2 * n + 3), n)
        if conv == 9:
            turns = [None] + turns[1:]
        for t in turns:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None])
            text = rng.choice(["Yes.", "No!", "well", "", " \n", None, "a. b", "Is it?　", "x" * 50, f"turn {t}.", f"say {t}"])
            rows.append((conv, t, role, text))
    rows.append((77, None, "user", None))
    return rows


def test_query_against_all_edits(spark, tmp_path):
    rows = conversations()
    at = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3).write.parquet(at)
    got = {r.conv_id: r for r in op11_repair.op11_repair(spark, str(tmp_path)).collect()}
    want = wanted(damage(rows), {r[0] for r in rows})
    assert got.keys() == want.keys()
    for conv, w in want.items():
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == w, conv


def test_rows_of_a_whole_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    got = {r.conv_id: r for r in op11_repair.op11_repair(spark, "/root/testdata/sf0.001").collect()}
    for conv, w in wanted(damage(rows), {r[0] for r in rows}).items():
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == w


def test_cost_layers_in_blocks_equal_the_whole():
    rng = random.Random(5)
    for _ in range(60):
        codes = "".join(rng.choice(op11_repair.CODES) for _ in range(rng.randint(1, 14)))
        cut = rng.randint(0, len(codes))
        parts = [p for p in (codes[:cut], codes[cut:]) if p]
        after, ends = list(op11_repair.TAIL_COST), []
        for p in reversed(parts):
            ends.append(after)
            after = [min(c + e for c, e in zip(row, after, strict=True) if c is not None) for row in op11_repair.costs(p)]
        state, audit = 0, ""
        for p, e in zip(parts, reversed(ends), strict=True):
            state, more = op11_repair.walk(p, op11_repair.layers(p), state, e)
            audit += more
        kinds = {"s": "system", "u": "user", "a": "assistant", ".": "tool"}
        fault = lambda c: [None, "truncated", "blank", "duplicate"][op11_repair.CODES.index(c) // 4]
        judged = [((kinds["sua."[op11_repair.CODES.index(c) % 4]], "x"), fault(c)) for c in codes]
        cost, best, _ = dijkstra(judged)
        assert (after[0], audit + op11_repair.TAIL[state]) == (cost, best)


def test_repaired_turns_follow_the_grammar(spark):
    rows = conversations(8)
    turns = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = {}
    for r in op11_repair.repaired(turns).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append(r.role[:1])
    for initials in got.values():
        assert re.fullmatch("s?(ua)+", "".join(initials))
    plan = {r.conv_id: r.audit for r in op11_repair.repair_plan(turns).collect()}
    assert {c: len(a) - a.count("D") for c, a in plan.items() if len(a) > a.count("D")} == {c: len(x) for c, x in got.items()}


def test_ties_repeats_and_nothing(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "assistant", "Ho."), (1, 0, "user", "Hi."), (1, None, None, None), (2, None, "user", "x"), (2, None, "user", "x")]
    turns = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    first = op11_repair.repair_report(turns).orderBy("conv_id").collect()
    assert first == op11_repair.repair_report(turns.repartition(3)).orderBy("conv_id").collect()
    assert (first[0].blank, first[0].duplicate, first[1].duplicate, first[1].gaps) == (1, 1, 1, 0)
    assert op11_repair.repair_report(turns.where("false")).collect() == []
    assert [tuple(r)[1:-1] for r in op11_repair.repair_report(turns.where("false"), turns).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


@pytest.mark.parametrize("sizes", [(500_000,)])
def test_very_long_texts(spark, sizes):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "word " * n + f"{i}.") for i, n in enumerate(sizes * 2)]
    got = op11_repair.repair_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert got[0].audit == "KK" and got[0].repaired_sha256 == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows).encode()).hexdigest()
