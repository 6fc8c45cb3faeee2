from itertools import permutations

from helpers import ODD, docs, odd_docs, words

from quiltwork.llm import filter_audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(rows, labels):
    """Each order applied to the documents one filter after another."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    fails = []
    for i, text, part in rows:
        text, w = text or "", words(text, fold=False)
        f = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and least[text] < i,
        }
        fails.append((part or "", i, f))
    out = []
    for part in {f[0] for f in fails}:
        mine, done, shapley = [f for f in fails if f[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [f for f in left if f[2][k]]
                left = [f for f in left if not f[2][k]]
                shapley[k] += len(gone)
                failing = [f for f in mine if f[2][k]]
                done.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(sum(f[2].values()) == 1 for f in failing), sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone)))
        out += [(*d, shapley[d[1][d[2] - 1]]) for d in done]
    return sorted(out)


def run(df, labels):
    return sorted(tuple(r[c] for c in COLUMNS) for r in filter_audit.audit(df, labels).collect())


def test_audit_equals_plain(spark, sf_dir):
    df, labels = docs(spark, sf_dir), docs(spark, sf_dir, "labels")
    assert run(df, labels) == plain([(r.doc_id, r.text, r.lang) for r in df.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])


def test_audit_odd_rows_and_labels(spark):
    marks = [(1, 1, 0), (1, 0, 1), (5, None, 1), (7, 1, None), (None, 1, 1), (10, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS part", "2 AS good", "3 AS mask")
    more = [(None, "one", "en", None, 0), (None, None, None, None, 0), (15, "ONE two", None, None, 0), (16, "A1 " * 200, "en", None, 0)]
    rows = [*ODD, *more]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS part", "2 AS step", "3 AS first", "4 AS bits", "5 AS _first", "6 AS text_key")
    assert run(df, labels) == plain([r[:3] for r in rows], marks)
    assert run(odd_docs(spark), labels) == plain([r[:3] for r in ODD], marks)
    assert run(df.limit(0), labels) == [] and len(run(df, labels.limit(0))) == 600 * 4


def test_large_groups_of_copies_are_looked_up_by_broadcast(spark, monkeypatch):
    """A text with a third of the rows, one of many smaller groups, and texts of their own."""
    rows = [(i, "same text" if i % 3 == 0 else f"text {i % 40}" if i % 3 == 1 else f"own {i}", "en") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 20)
    assert run(df, marks) == plain(rows, [])
