import hashlib
import random
import re

import numpy as np
from helpers import ODD, docs, odd_docs

from quiltwork.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(x - 9 * (x > 9) for x in twice) + sum(map(int, digits[::-2]))) % 10 == 0


def base(text):
    """The base spans by the definition: leftmost matches, failing ones dropped."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (q[-400:] for q in m[0].split("."))), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def check(spark, rows):
    """Base counts and digests of all rows; returns what was added."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in queries.personal_data(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=repr)
    want = []
    added = []
    for doc_id, text in rows:
        b = base(text)
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in b)
        want.append((doc_id, *[sum(s[0] == k for s in b) for k in BASE], hashlib.sha256(joined.encode()).hexdigest()))
    assert [g[:6] for g in got] == sorted(want, key=repr)
    texts = dict(rows)
    for g in got:
        spans = [(k, int(a), int(z)) for k, a, z in (s.split(":") for s in g[6].split(",") if s)]
        assert spans == sorted(spans, key=lambda s: (list(BASE).index(s[0]), s[1]))
        own = base(texts[g[0]])
        assert set(own) <= set(spans)
        for k, a, z in set(spans) - set(own):
            assert all(z <= x or a >= y for _, x, y in own)
            added.append((g[0], k, texts[g[0]][a:z]))
    return added


def test_base_spans_of_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in docs(spark, sf_dir).collect()]
    assert check(spark, rows) == []


def test_base_spans_of_odd_texts(spark):
    """Texts over few letters, so that matches meet, nest and fail in many ways."""
    rnd = random.Random(7)
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))) for i, letters in enumerate(["ab@.", "a@._+", "01.", "0123456789 -", "+0 1()-.", "9-5 +.@a", "é@a.\n1"] * 120)]
    rows += [(10_000 + i, "".join(rnd.choice("0123456789") + rnd.choice(("", "", "", " ", "-")) for _ in range(rnd.randint(14, 22)))) for i in range(600)]
    rows += [(20_000, None), (20_001, ""), (20_002, "a@b.c_d@e.f x@y.z@q.r 1.2.3.4.5.6.7.8 007.0.0.255 256.1.1.1"), (20_003, "🙂 " * 5 + "+1 (407) 555-7710 🙂 x@y.zz")]
    check(spark, rows)


def test_very_long_texts(spark):
    """Runs that a backtracking matcher would try from each place or stack up."""
    rows = [(1, "a" * 20_000 + "@b" + ".c" * 200_000), (2, "a" * 20_000), (3, "1" * 10_000), (4, "1." * 5_000), (5, "+1" + " 2" * 200_000), (6, "a@b.c " * 30_000), (7, "x" * 10_000 + " m@n.org 1.2.3.4"), (8, "0" * 20_000 + ".0.0.1")]
    check(spark, rows)


def test_very_long_runs_take_time_in_proportion(spark):
    """A million letters, digits or labels in one run; a search from each place would not end."""
    rows = [(1, "a" * 1_000_000), (2, "a" * 1_000_000 + "@b.c"), (3, "1" * 1_000_000), (4, "0" * 1_000_000 + ".0.0.1"), (5, "1." * 200_000)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [("email", 0, 1_000_004)], 3: [], 4: [("ip", 0, 1_000_006)], 5: [("ip", 8 * k, 8 * k + 7) for k in range(50_000)]}


def test_other_writings_are_learned(spark):
    """Disguised data is added next to plain data of its kind; look-alikes are left alone."""
    rows = []
    for i in range(60):
        rows += [(10 * i, f"Write to me{i}@host{i}.example.com or call +1 (407) 555-{1000 + i}, from 10.0.{i}.7"), (10 * i + 1, f"My mail: anna{i} [at] host{i} [dot] org"), (10 * i + 2, f"phone: (407) 555-{2000 + i}"), (10 * i + 3, f"Order 2024-01-{10 + i % 20} 1234, version 1.2.{i}"), (10 * i + 4, f"They were at home {i} and read a lot"), (10 * i + 5, f"login from 10[.]0[.]{i}[.]9"), (10 * i + 6, "card 378282246310005 and a4111111111111111b, token=12345678901234567")]
    added = check(spark, rows)
    assert {d % 10 for d, _, _ in added} == {1, 2, 5, 6}
    assert {k for _, k, _ in added} == {"email", "phone", "ip", "card"}
    assert sum(k == "email" for _, k, _ in added) == 60 and ("email", "anna7 [at] host7 [dot] org") in {(k, s) for _, k, s in added}
    assert sum(d % 10 == 6 for d, _, _ in added) == 60


def test_estimation_finds_the_labelers_worth():
    """Votes drawn from known reliabilities are told apart again."""
    rnd = np.random.default_rng(5)
    truth = rnd.random(20000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    votes = np.where(rnd.random((20000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rnd.random(votes.shape) < 0.2] = 2
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    table, share, chance = pii.reliabilities(counts.astype(float), patterns)
    assert abs(share - 0.3) < 0.02
    assert np.allclose(table[1, :, 1] / (table[1, :, 0] + table[1, :, 1]), right, atol=0.03)
    assert ((chance[where.ravel()] > 0.5) == truth).mean() > 0.95


def test_training_equals_its_definition():
    """At the weights the gradient of the penalised likelihood vanishes."""
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)
    positive, total = np.array([1.0, 5.0, 8.0, 20.0]), np.array([10.0, 12.0, 10.0, 21.0])
    w = pii.train(x, positive, total)
    p = 1 / (1 + np.exp(-(x @ w[:2] + w[2])))
    assert np.allclose(x.T @ (positive - total * p), w[:2] / 10, atol=1e-6) and abs((positive - total * p).sum() - w[2] / 100) < 1e-6


def test_pii_odd_rows(spark):
    clash = ("key", "finder", "i", "surface", "gap", "start", "end", "kind", "votes", "mask", "place", "_f", "_t")
    rows = [*[r[:2] for r in ODD], (None, "call +1 (407) 555-7710"), (None, "call +1 (407) 555-7710"), (3, "x@y.org x@y.org"), (3, "x@y.org x@y.org"), (3, "q@y.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'x' AS `{c}`" for c in clash])
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end, s.surface) for s in r.spans]) for r in pii.find(df).collect()), key=repr)
    assert got == sorted(((i, [(k, a, z, (t or "")[a:z]) for k, a, z in base(t)]) for i, t in rows), key=repr)
    assert pii.find(odd_docs(spark)).count() == len(ODD) and pii.find(df.limit(0)).count() == 0
    assert all(r.spans == [] for r in pii.find(df.where("text IS NULL OR text = ''")).collect())
