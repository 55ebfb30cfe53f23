"""Near copies against the Jaccard similarity of all pairs."""

import random
from itertools import combinations

import corpus_pipeline as P
from coloom.llm import jaccard
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_pipeline import SF, replaced, texts


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(rows):
    """{smallest id: ids} of the groups of (id, text) that pairs of similarity 0.8 connect."""
    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}
    for (i, a), (j, b) in combinations(sets, 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, set()).add(i)
    return groups


def cases():
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    out = [None, "", " ", "a b", "A  b", "a b c d e", "a b c d e f", "a b c d"]
    line = fresh(30)
    for _ in range(12):  # one common line, and copies with more and more words changed, some of them at the border
        base = fresh(rng.randint(20, 120)) + line
        for edits in (0, 0, 1, 2, 3, 4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = fresh(1)[0]
            out.append(" ".join(copy))
    chain = fresh(100)
    for _ in range(40):  # neighbours are alike, ends are not
        out.append(" ".join(chain))
        chain = chain[3:] + fresh(3)
    return out


def test_groups(spark):
    rows = list(enumerate(cases()))
    random.Random(6).shuffle(rows)
    want = slow_components(sorted(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in jaccard.near_groups(docs, "doc_id", "text").collect():
        got.setdefault(r.component_id, set()).add(r.id)
    assert got == want and any(len(g) > 30 for g in want.values())
    assert jaccard.near_groups(docs.limit(0), "doc_id", "text").count() == 0


def test_fingerprints_connect_all_pairs_within_the_radius(spark):
    from tests.llm.test_simhash import slow_components as slow_near

    sets = [jaccard.shingles((t or "").encode()) for t in cases()]
    rows = [(i, jaccard.simhash.fingerprint_of(s)) for i, s in enumerate(sets)]
    for s, (_, fp) in zip(sets, rows, strict=True):
        assert fp & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))
    want = slow_near(rows, 2)
    assert len(set(want)) < len(rows)
    pairs = jaccard.similar(spark.createDataFrame(rows, "node long, fp long")).collect()
    root = {i: i for i, _ in rows}
    for u, v in pairs:
        low, high = sorted((root[u], root[v]))
        root = {k: low if r == high else r for k, r in root.items()}
    assert [root[i] for i, _ in rows] == want


def test_stage_takes_links_by_fingerprints(spark, monkeypatch):
    found = []
    similar = jaccard.similar

    def seen(*args):
        found.append(similar(*args))
        return found[-1]

    monkeypatch.setattr(jaccard, "similar", seen)
    words = [f"w{i * i}" for i in range(8000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(words[:4000]))]
    kept = P.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert set(texts(kept)) == {1, 3}
    assert len(found) == 1 and found[0].count() > 0


def test_stage_and_those_after_it(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = P.language_id(spark, docs, SF)
    unique = P.simhash_near_dedup(spark, kept, SF)
    assert unique.columns == docs.columns
    now = texts(unique)
    assert set(now) == set(slow_components(sorted(texts(kept).items())))
    clean = texts(P.benchmark_decontamination(spark, unique, SF))
    assert clean == {i: t for i, t in now.items() if not slow_hits(t, bench, 10)[1]}
    private = P.personal_data(spark, unique.where(unique.doc_id.isin(list(clean))), SF)
    assert texts(private) == {i: replaced(t) for i, t in clean.items()}


def test_lists_are_shuffled_once(spark):
    from coloom.llm.jaccard import _live

    rows = [(1, 7), (1, 7), (1, 8), (2, 7), (2, 7), (3, 9), (4, 5), (4, 6)]
    live = _live(spark.createDataFrame(rows, "shingle long, node long"), "node")
    assert sorted(map(tuple, live.collect())) == [(1, 7), (1, 7), (1, 8), (4, 5), (4, 6)]
    assert live._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_posts_are_packed_and_not_stored(spark):
    """A row kept its prefix to the end, 0.38 x the input on disk; a post was a shingle, a place and a column each."""
    from coloom.llm import jaccard as J

    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l m"), (3, None)], "doc_id long, text string")
    assert J._nodes(docs, "doc_id", "text", 5).columns == ["id", "node", "fp"]
    want = set()
    for r in docs.collect():
        s = J.shingles((r.text or "").encode())
        want |= {(len(s), i + 1, int(x) >> 24) for i, x in enumerate(J.prefix(s, (J.np.zeros(0, J.np.uint64),) * 2))}
    posts = J._posts(docs, "text", 5)
    assert {(r.n, r.i, r.shingle) for r in posts.collect()} == want
    plan = J._live(posts, "node").distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    # A place beyond its bits is given as the last one they hold, which is earlier.
    places = J.PLACES
    J.PLACES = 3
    try:
        assert (J.packed(J.np.arange(8, 40, 4, dtype=J.np.uint64)) & J.np.uint64(3)).tolist() == [1, 2, 3, 3, 3, 3, 3, 3]
    finally:
        J.PLACES = places


def test_lists_go_before_the_last_sets(spark, monkeypatch):
    """Nobody holds the lists of shingles, nor their files, while the last candidates are verified."""
    import gc
    import weakref

    lists, held, cut = [], [], jaccard.cut

    def watch(df):
        if df.columns == ["node", "items"]:
            gc.collect()
            held.append(sum(ref() is not None for ref in lists))
        out = cut(df)
        if "shingle" in out.columns:
            lists.append(weakref.ref(out))
        return out

    monkeypatch.setattr(jaccard, "cut", watch)
    docs = spark.range(40).selectExpr("id", "concat('a b c d e f g h i j k l m n o p q r s t ', cast(id % 9 as string)) as text")
    assert jaccard.near_groups(docs, "id", "text").select("component_id").distinct().count() == 1
    assert len(lists) > 2 and held[-1] == 0
