import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.llm import repair
from foliospark.llm.queries import QUERIES

LEGAL = re.compile(r"(s?(ua)+)?\Z")
FULL = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        if not letters:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if letters[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def by_all_edits(rows):
    """Every edit of every row with up to two inserts around it, tried out."""
    found = faults(rows)
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    best = None
    for edits in product(["D", "K", "u", "a"], repeat=len(rows)):
        for inserts in product(gaps, repeat=len(rows) + 1):
            if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, found)):
                continue
            cost, audit, kept = 0, "", []
            for at in range(len(rows) + 1):
                for initial in inserts[at]:
                    cost, audit = cost + 2, audit + "I"
                    kept.append((FULL[initial], ""))
                if at < len(rows) and edits[at] == "D":
                    cost, audit = cost + 3, audit + "D"
                elif at < len(rows):
                    _, role, text = rows[at]
                    cost += (found[at] == "truncated") + 2 * (edits[at] != "K")
                    audit += "K" if edits[at] == "K" else "R"
                    kept.append((role if edits[at] == "K" else FULL[edits[at]], text))
            initials = "".join(role[:1] or "-" for role, _ in kept)
            if LEGAL.match(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, kept)
    return best


def by_recursion(rows):
    """The least (cost, initials) from each row on, without vectors or checkpoints."""
    found = faults(rows)
    n = len(rows)

    def then(state, initial):
        if initial == "s":
            return "s" if state == "" else None
        if initial == "u":
            return "u" if state in ("", "s", "a") else None
        return "a" if initial == "a" and state == "u" else None

    @lru_cache(None)
    def best(at, state, inserted):
        ways = []
        if at == n and state in ("", "a"):
            ways.append((0, "", ()))

        def add(cost, edit, after, kept):
            if after is not None:
                ways.append((cost + after[0], edit + after[1], kept + after[2]))

        if inserted < 2:
            for initial in "ua":
                if then(state, initial):
                    add(2, "I", best(at, then(state, initial), inserted + 1), ((FULL[initial], ""),))
        if at < n:
            _, role, text = rows[at]
            add(3, "D", best(at + 1, state, 0), ())
            if found[at] not in ("blank", "duplicate"):
                more = found[at] == "truncated"
                if then(state, role[:1]):
                    add(more, "K", best(at + 1, then(state, role[:1]), 0), ((role, text),))
                for initial in "ua":
                    if then(state, initial):
                        add(2 + more, "R", best(at + 1, then(state, initial), 0), ((FULL[initial], text),))
        return min(ways, default=None)

    cost, audit, kept = best(0, "", 0)
    return cost, audit, list(kept)


def summary(rows, solve):
    """The result row of ``(turn, role, text)`` rows in order."""
    cost, audit, kept = solve(rows)
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    joined = "\n".join(f"{role}:{text}" for role, text in kept)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(found.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256(joined.encode()).hexdigest(),
    )


def damaged(rows):
    """The fixed damage of (conv_id, turn, role, text) rows, by conversation."""
    found = {}
    for conv_id, turn, role, text in rows:
        held = found.setdefault(conv_id, [])
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    for held in found.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return found


def collected(df):
    return {row[0]: tuple(row[1:]) for row in df.collect()}


TEXTS = ["Yes.", "No", "", " \t", "Why?", "So. ", "x　", "!"]


def conversations(seed, many, longest, roles):
    draw = random.Random(seed)
    return {
        k: [(t, draw.choice(roles), draw.choice(TEXTS)) for t in range(draw.randint(1, longest))]
        for k in range(many)
    }


def frame(spark, found):
    rows = [(k, *row) for k, held in found.items() for row in held]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_all_edits_of_short_conversations(spark):
    found = conversations(1, 25, 2, ["system", "user", "assistant", "tool", ""])
    result = collected(repair.repair(frame(spark, found)))
    assert result == {k: summary(rows, by_all_edits) for k, rows in found.items()}


def test_recursion_agrees_with_all_edits():
    for rows in conversations(2, 25, 2, ["system", "user", "assistant", "x"]).values():
        assert by_recursion(rows) == by_all_edits(rows)


@pytest.mark.parametrize("longest", [12, 120])
def test_longer_conversations(spark, longest):
    found = conversations(longest, 60, longest, ["system", "user", "assistant", "user", "assistant"])
    result = collected(repair.repair(frame(spark, found)))
    assert result == {k: summary(rows, by_recursion) for k, rows in found.items()}


def test_query_against_recursion(spark):
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = rows.select("conv_id", "turn", "role", "text").collect()
    expected = {k: summary(held, by_recursion) for k, held in damaged(map(tuple, rows)).items()}
    assert collected(QUERIES["op13_repair"](spark, SF_DIR)) == expected


def test_only_a_root_of_the_vectors_is_stored():
    held = repair.Conversation()
    for place in range(10_000, 0, -1):
        held.backward(place, "ua"[place % 2 - 1], 0)
    assert len(held.stored) <= 102
    for place in range(1, 10_001):
        held.forward(place, ("user", "assistant")[place % 2 - 1], f"{place}.", 0)
        assert len(held.block) <= 100
    assert held.result()[5:7] == (0, "K" * 10_000)


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, place string, fault string"
    rows = [
        (1, None, None, None),
        (1, 2, "user", "Why?"),
        (1, 2, "assistant", "z" * 300_000 + "."),
        (1, 2, "assistant", "a."),
        (1, 2, "assistant", "a."),
        (None, 0, "user", "One."),
        (None, None, "assistant", "　"),
        (2, None, "user", "x"),
        (3, 0, "system", "Only this."),
        (4, 5, "user", "naïve 日本\x00!"),
        (4, 9, "", "no role."),
    ]
    df = spark.createDataFrame([r + ("clash", None) for r in rows], schema)
    expected = {k: summary(held, by_recursion) for k, held in damaged(rows).items()}
    assert collected(repair.repair(repair.damage(df))) == expected
    undamaged = {}
    for conv_id, *row in rows:
        row[1:] = [" " if v is None else v for v in row[1:]]
        undamaged.setdefault(conv_id, []).append(tuple(row))
    for held in undamaged.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    assert collected(repair.repair(df)) == {k: summary(h, by_recursion) for k, h in undamaged.items()}


def test_conversation_without_rows_left(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert collected(repair.repair(repair.damage(df))) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert repair.repair(repair.damage(df.filter(F.lit(False)))).isEmpty()
