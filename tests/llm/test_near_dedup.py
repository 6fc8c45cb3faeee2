import numpy as np
import pytest
from helpers import docs, odd_docs, words

from quiltwork.llm import near_dedup


def brute(rows, width, threshold=80):
    sets = {}
    for doc_id, text in rows:
        w = words(text)
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    common = {}
    for h in holders.values():
        for i, a in enumerate(h):
            for b in h[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), c in common.items():
        if 100 * c >= threshold * (len(sets[a]) + len(sets[b]) - c):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, sf_dir, width):
    df = docs(spark, sf_dir)
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], width)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.group(df, width).collect()}
    assert got == want


def test_chains_and_hot_groups(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
    rows, step = [], list(base)
    for k in range(60):  # a chain: neighbours are alike, the ends are not
        rows.append((k, " ".join(step)))
        step = list(step)
        step[k] = f"new{k}"
    for k in range(100, 400):  # near copies of one text
        t = list(base[::-1])
        t[int(rng.integers(0, 60))] = f"other{k}"
        rows.append((k, " ".join(t)))
    rows += [(k, "the same words again and again") for k in range(1000, 1300)]
    want = brute(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.group(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 2).collect()}
    assert got == want


def test_odd_rows(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.group(odd_docs(spark).where("doc_id <> 10"), 2).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[5] == (1, 4)
    assert got[7] == (1, 6)
    assert near_dedup.group(odd_docs(spark), 2).count() == odd_docs(spark).count()
    assert near_dedup.group(odd_docs(spark).limit(0), 2).count() == 0
    assert near_dedup.keep_one(odd_docs(spark)).columns == odd_docs(spark).columns


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((40, 0.5), (400, 0.8), (3, 1.0)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[int(n * share) :] = rng.integers(0, 2**63, n - int(n * share)).astype(np.uint64)
        e = np.concatenate([np.unique(a), np.unique(b)])
        sig = near_dedup.super_minhash(e, np.array([0, n, 2 * n]), 256)
        assert np.isfinite(sig).all()
        inter = len(np.intersect1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - inter / (2 * n - inter)) < 0.12


def test_rows_without_id_and_repeated_rows(spark):
    text = " ".join(f"t{k}" for k in range(40))
    near = text.replace("t39", "other")
    rows = [(None, text), (None, text), (5, near), (5, near), (7, text), (None, "alone in the world of words"), (None, "alone in the world of words"), (None, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.group(df).collect()), key=str)
    want = [(None, 5, False)] * 2 + [(5, 5, True)] * 2 + [(7, 5, False)] + [(None, None, False)] * 3 + [(9, 9, True)]
    assert got == sorted(want, key=str)
    kept = sorted((tuple(r) for r in near_dedup.keep_one(df).collect()), key=str)
    assert kept == sorted([(5, near), (None, "alone in the world of words"), (None, ""), (9, None)], key=str)


def test_heaps_are_compared_in_blocks(spark, monkeypatch):
    """Texts that share buckets but not the similarity: every link is found whatever the size of the blocks."""
    monkeypatch.setattr(near_dedup, "SMALL_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "HEAD_ROUNDS", 0)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in range(60)]
    rows = []
    for k in range(240):
        t = list(base)
        for at in rng.choice(60, int(rng.integers(3, 9)), replace=False):
            t[at] = f"v{rng.integers(0, 3)}"
        rows.append((k, " ".join(t)))
    want = brute(rows, 2)
    assert 3 < len({c for _, c, _ in want.values()})
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.group(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2).collect()}
    assert got == want
