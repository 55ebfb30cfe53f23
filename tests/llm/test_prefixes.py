"""The prefix trie against one that is built node by node."""

import hashlib
import random
from zlib import crc32

from pyspark.sql import functions as F

from coloom.llm import prefixes as T

SCHEMA = "conv_id long, turn long, role string, text string, node long, s string, d int"


def slow(rows, head=True):
    """{(conv_id, depth): (parent, n, children, leaves, saved, ends)} of [(conv, turn, role, text)]."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [v[2:] for v in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = crc32(str(c).encode()) % 9 if head else 0
        base = int(c / 5) * 5 if c < 0 else c - c % 5
        whole[c] = own.get(base, [])[:h] + t[h:]
    nodes = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    name = {n: (min(m), len(n)) for n, m in nodes.items()}
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids.get(n, [])) or 1
        saved[n] = sum(saved[k] for k in kids.get(n, [])) + ((len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    out = {}
    for n, m in nodes.items():
        ends = sorted(c for c in m if len(whole[c]) == len(n))
        out[name[n]] = (name[n[:-1]][0] if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n], ends)
    return out


def got(spark, rows, head=True):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    turns = T.ordered(df)
    nodes, ends = T.trie(*T.rebuilt(turns)) if head else T.trie(turns.select("conv").distinct(), turns)
    found = {}
    for r in ends.collect():
        found.setdefault((r.conv_id, r.depth), []).append(r.end)
    digests = {(r.conv_id, r.depth): r.ends_sha256 for r in T.end_digests(ends).collect()}
    assert digests == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in found.items()}
    rows = nodes.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, sorted(found.get((r.conv_id, r.depth), []))) for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, convs, words, most):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.randint(1, most)):
            rows.append((c * rnd.choice((1, 1, 1, 3)) - 9, t, rnd.choice(("user", "assistant")), rnd.choice(words)))
    return rows


def test_against_nodes(spark):
    for seed, convs, words, most in ((1, 60, ["a", "é", "", "b" * 50], 3), (2, 40, ["x"], 12), (3, 90, ["p", "q"], 2)):
        rows = made(seed, convs, words, most)
        assert got(spark, rows) == slow(rows)
        assert got(spark, rows, head=False) == slow(rows, head=False)


def test_edge_rows(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (1, 0, "user", "a"), (None, 0, "user", "z"), (6, 3, "user", "b"), (6, 3, "user", "a"), (10, 1, "user", "x" * 300000)]
    assert got(spark, rows) == slow(rows)
    assert got(spark, rows[4:5]) == {} and got(spark, []) == {}


def test_hot_groups(spark, monkeypatch):
    """Copies, a long conversation with alike rows, and node ends in many runs."""
    monkeypatch.setattr(T, "TOGETHER", 7)
    rows = [(c, t, "user", "abc"[t]) for c in range(300) for t in range(3)] + [(1000, 5, "user", "a")] * 400 + [(2001, t, "user", str(t % 3)) for t in range(400)]
    assert got(spark, rows, head=False) == slow(rows, head=False)
    assert got(spark, rows) == slow(rows)
    # A conversation's rows are in more than one part.
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert T.ordered(df.repartition(8)).where("conv = 1000").select(F.countDistinct("pos")).first()[0] == 400
