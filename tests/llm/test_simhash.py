"""SimHash links against all pairs."""

import random

import pytest
from xxhash import xxh64_intdigest

from coloom.llm import simhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_print(text, width=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius):
    """{row: smallest id reachable} over (id, fp)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(prints[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(prints))]


def unsigned(x):
    return x & (2**64 - 1)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("text", [None, "", " \t", "one", "A b", "a B c D é É", "x " * 9, "w%d " * 3 % (1, 2, 3), "ab cd " * 70000])
def test_fingerprint(text):
    assert unsigned(simhash.fingerprint((text or "").encode())) == slow_print(text)


@pytest.mark.parametrize("radius,parts,crowd", [(2, 2, 64), (2, 3, 64), (2, 4, 2), (3, 3, 64), (3, 3, 1), (4, 3, 4), (1, 2, 64)])
def test_links_match_all_pairs(spark, radius, parts, crowd):
    rng = random.Random(radius * 100 + parts * 10 + crowd)
    fps = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            near = base
            for _ in range(rng.randint(0, 3)):
                near ^= 1 << rng.randrange(64)
            fps.append(near)
            base = near if rng.random() < 0.3 else base
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {(unsigned(r.u), unsigned(r.v)) for r in simhash.links(df, radius, parts, crowd).collect()}
    assert all(bin(u ^ v).count("1") <= radius for u, v in found)
    index = {f: i for i, f in enumerate(fps)}
    want = slow_components([(i, f) for i, f in enumerate(fps)], radius)
    root = list(range(len(fps)))
    for _ in fps:
        for u, v in found:
            a, b = index[u], index[v]
            root[a] = root[b] = min(root[a], root[b])
    assert root == want


def test_rows(spark):
    near = " ".join(f"w{i}" for i in range(900))
    rows = [(5, near), (3, near + " w900"), (9, None), (8, ""), (8, ""), (None, "alone here now"), (7, "other text by far"), (4, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as id")
    got = sorted((r.id is None, r.id or 0, unsigned(r.fp), r.component_id) for r in simhash.near_groups(docs).collect())
    prints = [(i, slow_print(t)) for i, t in rows]
    comp = slow_components(prints, 2)
    assert got == sorted((i is None, i or 0, f, c) for (i, f), c in zip(prints, comp, strict=True))
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash_near_dedup(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(d.doc_id, slow_print(d.text)) for d in docs]
    comp = slow_components(prints, 2)
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(prints, comp, strict=True)}


def test_allocation_is_cheapest():
    import numpy as np
    from itertools import product

    rng = np.random.default_rng(1)
    costs = rng.random((20, 3, 4))
    costs[:, :, 0] = 0
    got = simhash.allocate(costs, 0)
    for row, t in zip(costs, got, strict=True):
        best = min(sum(row[i, x + 1] for i, x in enumerate(c)) for c in product(range(-1, 3), repeat=3) if sum(c) == 0)
        assert sum(t) == 0 and abs(sum(row[i, x + 1] for i, x in enumerate(t)) - best) < 1e-12
