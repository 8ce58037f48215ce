"""The trie of conversation prefixes against a plain version."""

import hashlib
import math
import random
import zlib

import pytest

from loomline.llm import prefix_trie
from tests.conftest import same


def brute(convs):
    """convs: id -> [(role, text)]; the rows of the trie."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), sum(len(p) == len(path) + 1 for p in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def ordered(rows):
    """id -> [(role, text)] in the order of turns."""
    text = lambda r: (r[2] or "", r[3] or "")
    digest = lambda r: hashlib.md5(f"{len(text(r)[0])} {text(r)[0]}{text(r)[1]}".encode()).hexdigest()
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r))):
        out.setdefault(r[0], []).append(text(r))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def rows():
    """Shared beginnings, long conversations, equal ones, ties, nulls, negative and far ids."""
    rng = random.Random(5)
    say = lambda: rng.choice(["hello", "yes", "no", "", "été", "a longer text " * 3])
    out = []
    for c in [*range(60), 100, 104, 205, 206, -3, 10**12]:
        out += [(c, t, rng.choice(["user", "assistant"]), say()) for t in range(rng.randint(1, 6))]
    shared = [("user", f"turn {k % 3}") for k in range(23)]
    for c in range(300, 330):
        own = shared[: rng.randint(9, 23)]
        out += [(c, t, *x) for t, x in enumerate(own)]
    out += [(400, None, None, None), (400, None, "user", None), (400, 1, "user", "tie"), (400, 1, "user", "other"), (400, 1, "user", "tie"), (None, 0, "user", "lost"), (None, 1, "user", "lost")]
    return out


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in rows()], "conv_id long, turn long, role string, text string, at int, block string").repartition(5)


@pytest.mark.parametrize(("shard", "depth"), [(2048, 64), (7, 4), (1, 1), (1000, 2)])
def test_trie(turns, monkeypatch, shard, depth):
    monkeypatch.setattr(prefix_trie, "STRETCH", 2)
    got = prefix_trie.prefix_trie(turns, shard, depth).drop("chars").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (*r[:2],)) == brute(ordered(rows()))


@pytest.mark.parametrize(("shard", "depth"), [(2048, 64), (5, 2)])
def test_rebuilt_trie(turns, shard, depth):
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.positions(turns)), shard, depth).drop("chars").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (*r[:2],)) == brute(rebuilt(ordered(rows())))


def test_conversations_over_many_tasks(spark):
    """A third of all rows in one conversation, equal rows among them, and a text that all conversations begin with."""
    long = [(7, t // 3, "user", "a" if t % 3 else "b") for t in range(400)]
    other = [(c, t, "user", "a") for c in range(200, 400) for t in range(4)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(long + other, "conv_id long, turn long, role string, text string").repartition(6), 16, 8).drop("chars")
    convs = ordered(long + other)
    at = prefix_trie.positions(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))
    assert sorted(r["at"] for r in at.collect()) == list(range(400))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (*r[:2],)) == brute(convs)


def test_conversations_without_turns(spark):
    ids = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 2][:4]
    only = spark.createDataFrame([(c, 0, "user", "gone") for c in ids], "conv_id long, turn long, role string, text string")
    (root,) = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.positions(only))).drop("chars").collect()
    assert tuple(root) == (min(ids), 0, None, 4, 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).count() == 0
    nameless = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(nameless).count() == 0


def test_query(spark, sf_dir, duck):
    same(prefix_trie.op11_prefix_trie(spark, sf_dir).toPandas(), duck.execute(prefix_trie.SQL["op11_prefix_trie"]).df())
