import random

import pytest
import xxhash

import corpus_pipeline
from tests.llm.test_duplicates import near_texts
from voxmill.llm import nearcopies, simhash
from voxmill.operators import graph


def brute(rows):
    """The kept (doc_id, text) by all pairs; nulls come last. Rows are to have unlike (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if s == t or (s | t and 5 * len(s & t) >= 4 * len(s | t)):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    own = {}
    for k in range(len(rows)):
        own.setdefault(root(k), []).append(rows[k])
    return own.values()


def rank(row):
    return (row[0] is None, row[0] or 0)


def test_stage_against_jaccard(spark, make, small):
    texts = [*near_texts(150), *small, "", "A b c", "a B C"]
    rows = list(enumerate(texts))
    want = sorted(min(group, key=rank)[0] for group in brute(rows))
    got = sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, make(rows), "").collect())
    assert got == want and len(want) < len(rows)
    assert corpus_pipeline.without_near_duplicates(spark, make(rows).limit(0), "").count() == 0


def test_chains_and_large_groups(spark, make):
    """Chains whose ends are unlike, and many near copies of one text, some of them linked by others only."""
    r, word = random.Random(4), lambda k: f"w{k}"
    line = [word(r.randrange(10**6)) for _ in range(300)]
    rows = [(1000 - 10 * k, " ".join(line[k * 12 : k * 12 + 150])) for k in range(12)]
    base = [word(r.randrange(10**6)) for _ in range(200)]
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(200)] = word(r.randrange(10**6))
        rows.append((2000 + i, " ".join(w)))
    want = sorted(min(group, key=rank)[0] for group in brute(rows))
    assert sorted(r.doc_id for r in nearcopies.keep_first(make(rows)).collect()) == want
    assert 890 in want and 900 not in want


def test_repeated_and_null_ids(spark, make):
    """Unlike texts stay though they share a doc_id or have none; of copies one row stays, and never a near copy in its place."""
    r = random.Random(7)
    base = [" ".join(f"v{r.randrange(10**6)}" for _ in range(150)) for _ in range(4)]
    near = lambda t: " ".join(["aaa", *t.split()[1:]])
    rows = [(None, base[0]), (None, base[1]), (3, base[2]), (5, base[3]), (5, near(base[2])), (7, "one more clean text of its own")]
    twice = [*rows, rows[0], rows[5], rows[5]]
    want = sorted((min(g, key=rank) for g in brute(rows)), key=str)
    got = sorted(((x.doc_id, x.text) for x in nearcopies.keep_first(make(twice)).collect()), key=str)
    assert got == want and len(want) == 5


def test_fingerprints_propose_the_pairs(spark, make, monkeypatch):
    """Every pair at 0.8 or more shares a cluster of wide SimHash fingerprints, in many tables too; without them no near copy is linked."""
    r = random.Random(11)
    base = [[f"u{r.randrange(10**6)}" for _ in range(r.choice((12, 60, 300)))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(4):
            w = list(b)
            for _ in range(r.randrange(1, 1 + len(w) // 50 + 1)):
                w[r.randrange(len(w))] = f"u{r.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = [nearcopies.grams(t) for t in texts]
    nodes, sizes, fps = nearcopies.fingerprints(texts)
    for own, fp in zip(sets, fps, strict=True):  # the first word, by its definition
        hashes = [xxhash.xxh64_intdigest(g, simhash.SEED) for g in own]
        want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert int.from_bytes(fp[:8], "little") == want
    df = spark.createDataFrame(sorted(set(zip(nodes, sizes, fps, strict=True))), "node long, size long, fp binary")
    near = [(nodes[a], nodes[b]) for a in range(len(texts)) for b in range(a) if nodes[a] != nodes[b] and nearcopies.similarity(sets[a], sets[b]) >= nearcopies.LEAST]
    assert len(near) > 100
    for group in (2048, 16):
        own = {}
        for x in simhash.near_groups(df, nearcopies.LEAST, group).collect():
            own.setdefault(x.node, set()).add(x.key)
        assert all(own.get(a, set()) & own.get(b, set()) for a, b in near)

    rows = list(enumerate(texts))
    want = sorted(min(g, key=rank)[0] for g in brute(rows))
    stage = lambda: sorted(x.doc_id for x in corpus_pipeline.without_near_duplicates(spark, make(rows), "").collect())
    assert stage() == want
    monkeypatch.setattr(simhash, "near_groups", lambda *_: spark.createDataFrame([], "key long, node long"))
    assert len(stage()) == len(set(nodes)) > len(want)


def test_components_at_once_are_those_of_rounds(spark):
    """One task or rounds: the same components, whatever the bound."""
    r = random.Random(5)
    edges = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    pairs = spark.createDataFrame(edges, "a long, b long").repartition(5)
    count = sum(a != b for a, b in edges)
    want = sorted(map(tuple, graph.star_components(pairs).collect()))
    assert all(sorted(map(tuple, graph.star_components(pairs, k).collect())) == want for k in (1, count - 1, count, 10**9))
    assert graph.star_components(pairs.limit(0), 10).count() == 0


def test_few_jobs_for_a_small_table(spark, make):
    """The driver's memory goes into planning and compiling jobs: a small table takes no rounds of stars."""
    rows = list(enumerate(near_texts(150)))
    spark.sparkContext.setJobGroup("near", "near")
    try:
        kept = nearcopies.keep_first(make(rows)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(x.doc_id for x in kept) == sorted(min(group, key=rank)[0] for group in brute(rows))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near")) <= 110
