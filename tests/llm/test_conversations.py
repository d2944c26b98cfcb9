"""Repair and trie of conversations against plain code, with conversations that go over many ranges and blocks."""

import hashlib
import random
import re
import zlib

import pytest
from cloakline.llm import repair, trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = ["Yes.", "No!", "", "  ", "why", "Why?", "tell me", "Fine. "]


def conversations(seed, long=0):
    """Rows with nulls, ties, repeated rows, odd roles; `long` turns in one conversation."""
    rng, rows = random.Random(seed), []
    for conv in [None, -105, -100, 0, 1, 2, 3, 7, 100, 101, 250]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), rng.choice(["system", "user", "assistant", "assistant", None, "", "tool"]), rng.choice([*WORDS, None, f"turn {turn}."])))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    rows += [(7, k, ("user", "assistant", "user", "system")[rng.randint(0, 3)], rng.choice([*WORDS, f"Turn {k // 2}.", f"Turn {k}."])) for k in range(10, 10 + long)]
    rows += [(conv, k, "user", f"Copy {k}.") for conv in range(300, 320) for k in range(4)]
    return rows


def clashing(df):
    return df.selectExpr("*", "1 as part", "'x' as name", "2 as pos", "'y' as kind", "3 as depth", "'z' as key", "4 as h", "5 as i")


def in_order(rows):
    line = lambda r: f"{r[2]}:{r[3]}"
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, line(r)[:64], hashlib.md5(line(r).encode()).hexdigest()))


def cheapest(rows):
    """Cost, letters and lines, turn by turn forward: the least (cost, letters) of each state."""
    start = {"": (0, "", [])}

    def inserted(best):
        while True:
            more = dict(best)
            for state, (cost, letters, lines) in best.items():
                to, name = ("a", "assistant") if state == "u" else ("u", "user")
                way = (cost + 3, letters + "I", [*lines, f"{name}:"])
                if to not in more or way[:2] < more[to][:2]:
                    more[to] = way
            if more == best:
                return best
            best = more

    best, seen, counts = inserted(start), set(), [0, 0, 0]
    for role, text in rows:
        fault = 0 if not text.strip(" \t\n\x0b\x0c\r") else 1 if (role, text) in seen else 2 if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        ways = {}

        def offer(state, way, ways=ways):
            if state not in ways or way[:2] < ways[state][:2]:
                ways[state] = way

        for state, (cost, letters, lines) in best.items():
            offer(state, (cost + 4, letters + "D", lines))
            if fault in (0, 1):
                continue
            more = 3 if fault == 2 else 0
            for name in ("user", "assistant"):
                if (name[0] == "a") == (state == "u"):
                    offer(name[0], (cost + 3 + more, letters + "R", [*lines, f"{name}:{text}"]))
            if role[:1] in ("u", "a") and (role[0] == "a") == (state == "u") or role[:1] == "s" and state == "":
                offer(role[0], (cost + more, letters + "K", [*lines, f"{role}:{text}"]))
        best = inserted(ways)
    cost, letters, lines = min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])
    return cost, letters, lines, counts


def plainly_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text)
        out += [row] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def plainly_repaired(rows, damaged_rows):
    out = {}
    for conv in {r[0] for r in rows}:
        held = in_order([r for r in damaged_rows if r[0] == conv])
        cost, letters, lines, counts = cheapest([r[2:] for r in held])
        turns = {r[1] for r in held if r[1] is not None}
        roles = [r[2][:1] for r in held]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest(), "\n".join(lines))
    return out


@pytest.mark.parametrize(("seed", "long", "parts"), [(1, 0, 2), (2, 300, 9), (3, 150, 40)])
def test_repair_against_plain_code(spark, seed, long, parts):
    rows = conversations(seed, long)
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(df), parts=parts).collect()}
    assert got == plainly_repaired(rows, plainly_damaged(rows))


def test_repair_without_damage_and_without_rows(spark):
    rows = [(1, 0, "user", "Hello there."), (1, 1, "assistant", "Hello."), (2, 0, "assistant", "Cut off"), (3, 0, "user", "x" * 100_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: (r.cost, r.audit) for r in repair.repair(df, texts=False).collect()}
    assert got == {1: (0, "KK"), 2: (4, "D"), 3: (3, "KI")}
    none = repair.repair(df.withColumn("present", F.lit(False))).collect()
    assert {tuple(r)[1:9] for r in none} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(none) == 3
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_trie(rows):
    convs = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        convs[conv] = [r[2:] for r in in_order([(c, t, role or "", text or "") for c, t, role, text in rows if c == conv])]
    base = lambda c: c - (abs(c) % 100 * (1 if c >= 0 else -1))
    paths = {c: tuple(convs.get(base(c), [])[: zlib.crc32(str(c).encode()) % 6]) + tuple(own[zlib.crc32(str(c).encode()) % 6 :]) for c, own in convs.items()}
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1]) if node else 0
    ends = lambda node: ",".join(str(c) for c in sorted(c for c in members[node] if len(paths[c]) == len(node)))
    return sorted((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends(node).encode()).hexdigest()) for node, held in members.items())


@pytest.mark.parametrize(("seed", "long", "parts", "blocks"), [(1, 0, 2, 1), (2, 60, 9, 13), (3, 0, 40, 60)])
def test_trie_against_plain_code(spark, seed, long, parts, blocks):
    rows = conversations(seed, long)
    rows += [(conv, *r[1:]) for r in rows if r[0] == 7 for conv in (8, 9)]  # long copies
    rows += [(c, k, "user", f"{c % 3 if k > 2 else 0} {k}") for c in range(1000, 1060) for k in range(c % 5 + 1)]
    got = trie.conversation_trie(clashing(spark.createDataFrame(rows, SCHEMA)), parts, blocks).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_trie(rows), key=str)


def test_trie_without_conversations_or_turns(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    # Conversation 1 loses its first turns to a base that isn't there: 1 % 100 is 1, and its h is more than 0.
    rows = [(1, 0, "user", "Hello.")]
    assert list(map(tuple, trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect())) == plain_trie(rows)


def test_nearest_smaller_values():
    rng = random.Random(5)
    for _ in range(50):
        values = [rng.randint(0, 4) for _ in range(rng.randint(1, 30))]
        before, behind = trie.nearest_smaller(values)
        for i, v in enumerate(values):
            assert before[i] == max((j for j in range(i) if values[j] < v), default=-1)
            assert behind[i] == min((j for j in range(i + 1, len(values)) if values[j] < v), default=len(values))
