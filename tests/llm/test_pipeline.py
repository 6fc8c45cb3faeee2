from collections import Counter

import corpus_pipeline
from helpers import ODD, docs
from test_near_dedup import brute
from test_operators import measures, ppm_bits, sequential_bfd, tokenizer

import __spark_entry__
from quiltwork.llm import packing


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    current = docs(spark, sf_dir)
    columns = current.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = current
        current = stage(spark, before, sf_dir).cache()
        assert current.columns == columns, name
        assert current.join(before, columns, "left_anti").count() == 0
        assert 0.5 * before.count() < current.count() <= before.count()
    assert current.count() < docs(spark, sf_dir).count()
    last = corpus_pipeline.STAGES[-1][1](spark, current, sf_dir)
    want = {tuple(r) for r in packing.pieces(current).collect()}
    assert {tuple(r)[:5] for r in last.collect()} == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in current.select("doc_id").collect()}


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_equals_brute_force(spark, sf_dir):
    """Every stage on a small table with odd rows, against plain Python; so few labels give no cutoffs."""
    plain = [tuple(r) for r in docs(spark, sf_dir).orderBy("doc_id").limit(30).collect()]
    plain = [(r[0], r[1] if r[1] is None else r[1][:500], *r[2:]) for r in plain]
    odd = [(r[0] + 10**6, *r[1:]) for r in ODD if r[0] != 8] + [(None, "a text without a name that stands here alone by itself", "en", "x", 1)] * 2 + [(None, None, None, None, None)]
    rows = plain + odd + plain[:3]
    names = ("doc_id", "text", "lang", "source", "n_chars")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS _row", "1 AS score", "2 AS component", "3 AS length").repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    texts = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and r[2] is not None:
            texts.setdefault(r[2], []).append(r[1].encode())

    def known(text):
        if text is None or not any(map(str.isalpha, text)):
            return False
        return min(ppm_bits(own, text.encode()) for own in texts.values()) <= 8 * len(text.encode())

    verdict = {t: known(t) for t in {r[1] for r in rows}}
    kept = [r for r in rows if verdict[r[1]]]
    got = stages["language_id"](spark, df, sf_dir)
    assert got.columns == df.columns and Counter(tuple(r) for r in got.select(*names).collect()) == Counter(kept)
    count = {r[1]: measures(r[1]) for r in kept}
    kept = [r for r in kept if count[r[1]][0] >= 10 and 100 * count[r[1]][4] <= 20 * count[r[1]][0]]
    got = stages["quality_rules"](spark, got, sf_dir)
    assert got.columns == df.columns and Counter(tuple(r) for r in got.select(*names).collect()) == Counter(kept)
    own = {r[0]: r for r in kept if r[0] is not None}
    groups = brute([(k, r[1]) for k, r in own.items()], 5)
    kept = [own[k] for k, (_, _, first) in groups.items() if first] + sorted({r for r in kept if r[0] is None})
    got = stages["near_dedup"](spark, got, sf_dir)
    assert got.columns == df.columns and Counter(tuple(r) for r in got.select(*names).collect()) == Counter(kept)
    t = tokenizer()
    want = Counter()
    lengths = []
    for r in kept:
        n = len(t.encode(r[1], add_special_tokens=False).ids) + 1
        cut = [0, *range(n % 2048 or 2048, n, 2048), n]
        for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            want[r[0], p, a, b - a] += 1
            lengths.append(b - a)
    out = stages["packing"](spark, got, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in out) == want
    assert len({r.sequence_id for r in out}) == len(sequential_bfd(lengths, 2048))


def test_empty_tables(spark, sf_dir):
    none = docs(spark, sf_dir).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
