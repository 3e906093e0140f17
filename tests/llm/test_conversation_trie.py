"""The trie against plain Python over dictionaries of prefixes."""

import hashlib
import math
import random
import zlib

import pyarrow as pa
import pytest

from labelspark.llm import conversation_trie as C
from tests.llm.data import plain

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(turns):
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(rows)] for c, rows in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - int(math.fmod(c, 100))  # the remainder has the sign of c, as in SQL
        out[c] = own.get(lead, [])[:h] + mine[h:]
    return out


def expected(conversations):
    members = {}
    for c, path in conversations.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        kids = [m for m in members if len(m) == len(node) + 1 and m[: len(node)] == node]
        under = [m for m in members if m[: len(node)] == node]
        inner = {m[:-1] for m in members if m}
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in under if m)
        ends = sorted(c for c in convs if len(conversations[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids),
            sum(m not in inner for m in under), saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def result(spark, turns, extra=()):
    table = spark.createDataFrame(turns, SCHEMA).selectExpr("*", *extra)
    return plain(C.trie(C.branched(C.paths(table))))


def made(seed, n, longest, words="abc"):
    pick = random.Random(seed)
    return [
        (c, turn, pick.choice(["user", "assistant"]), pick.choice(words) * pick.randint(0, 3))
        for c in range(n) for turn in range(pick.randint(0, longest))
    ]


def test_nulls_copies_and_turnless(spark):
    turns = made(1, 230, 4) + [
        (500, None, "user", "first"), (500, 0, "user", None), (500, 1, None, "é\U0001f600"),
        (None, 0, "user", "lost"), (601, 0, "", ""), (602, 0, None, None), (601, 0, "", ""),
        (-7, 0, "user", "below zero"),
    ]
    turns += [(700 + i, t, "user", f"same {t}") for i in range(300) for t in range(3)]
    clashing = ["1 AS key", "2 AS n", "'x' AS node", "3 AS d", "4 AS size", "5 AS path"]
    assert result(spark, turns, clashing) == expected(rebuilt(turns))


def test_turns_with_one_number_have_an_order(spark):
    turns = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "user", "c")]
    assert result(spark, turns) == result(spark, turns[::-1])


def test_blocks_continue_and_tails_are_chains(spark):
    """Shared prefixes that end before, at and after a block's end, and long single tails."""
    shared = [("user", f"turn {i}") for i in range(40)]
    lengths = [7, 8, 9, 15, 16, 17, 40, 40, 31]
    paths = {c: shared[:n] for c, n in enumerate(lengths)}
    paths |= {20 + n: shared[:n] + [("user", f"own {n} {i}") for i in range(20)] for n in (3, 8, 16, 24)}
    paths |= {50: [("user", "alone")] * 30, 51: []}
    turns = [(c, i, r, t) for c, path in paths.items() for i, (r, t) in enumerate(path)]
    conversations = {c: p for c, p in paths.items() if p}
    table = C.paths(spark.createDataFrame(turns, SCHEMA))
    empty = spark.createDataFrame([(51, [])], "conv_id long, path array<binary>")
    assert plain(C.trie(table.unionByName(empty))) == expected(conversations | {51: []})


def test_member_lists_in_pieces(monkeypatch):
    """Lists cut into short pieces, over several batches, have the digest of the whole list."""
    monkeypatch.setattr(C, "PIECE_IDS", 4)
    members = [(bytes([k]), i * 3) for k, n in ((1, 50), (2, 1), (3, 4), (4, 5)) for i in range(n)]

    def batches(rows, names, size):
        for at in range(0, len(rows), size):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[at : at + size]])

    pieces = [r for b in C._pieces(batches(members, ("seq", "conv_id"), 7)) for r in b.to_pylist()]
    assert max(p["said"].count(",") for p in pieces) == 3 and len(pieces) == 13 + 1 + 1 + 2
    rows = [(p["seq"], p["said"]) for p in pieces]
    hashed = [r for b in C._hashed(batches(rows, ("seq", "said"), 3)) for r in b.to_pylist()]
    for k, n in ((1, 50), (2, 1), (3, 4), (4, 5)):
        want = hashlib.sha256(",".join(str(i * 3) for i in range(n)).encode()).hexdigest()
        assert [h["ends_sha256"] for h in hashed if h["seq"] == bytes([k])] == [want]


def test_empty_and_turnless_tables(spark):
    assert result(spark, []) == []
    empty = spark.createDataFrame([(4, []), (9, [])], "conv_id long, path array<binary>")
    assert plain(C.trie(empty)) == expected({4: [], 9: []})


@pytest.mark.parametrize("seed", [2, 3])
def test_random_conversations(spark, seed):
    turns = made(seed, 60, 20, "ab")
    assert result(spark, turns) == expected(rebuilt(turns))
