import hashlib
import zlib
from collections import Counter

from helpers import ODD, docs, odd_docs

from quiltwork.llm import branch_merge

COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def code(branch, doc_id, name):
    return zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 17


def branch(name, doc_id, lang, source, text):
    """One branch's own state, as a user would have made it: columns, lines with their drops and edits, gaps, dropped or not."""
    edit = lambda v, k: {0: "", 1: v + "!", 2: v + "?"}.get(k, v)
    lines, gaps = {}, {}
    for i, line in enumerate(text.split("\n")):
        k = code(name, doc_id, i)
        if k < 3:
            lines[i] = None if k == 0 else line + "!?"[k - 1]
        if k in (3, 4):
            gaps[i] = "!?"[k - 3]
    return {"lang": edit(lang, code(name, doc_id, "lang")), "source": edit(source, code(name, doc_id, "source")), "lines": lines, "gaps": gaps, "row": code(name, doc_id, "row")}


def merged(doc_id, lang, source, text):
    """Both branches' states compared unit by unit."""
    a, b = branch("L", doc_id, lang, source, text), branch("R", doc_id, lang, source, text)
    base, lines = {"lang": lang, "source": source}, text.split("\n")
    touched = {id(s): bool(s["lines"] or s["gaps"] or s["lang"] != lang or s["source"] != source) for s in (a, b)}
    n = Counter()

    def show(s, units, gaps):
        out = []
        for i, line in enumerate(lines):
            if units.get(i, line) is not None:
                out.append(units.get(i, line))
            if i in gaps:
                out.append(gaps[i])
        return s["lang"], s["source"], hashlib.sha256("\n".join(out).encode()).hexdigest()

    if a["row"] == 0 or b["row"] == 0:
        other = b if a["row"] == 0 else a
        fight = not (a["row"] == 0 and b["row"] == 0) and touched[id(other)]
        n["n_edit_delete" if fight else "n_clean"] += 1
        state = show(a, a["lines"], a["gaps"]) if a["row"] != 0 and fight else (None, None, None)
        return (doc_id, *state, *[n[c] for c in COUNTS])
    state = {}
    for c in ("lang", "source"):
        x, y = a[c], b[c]
        if x != base[c] and y != base[c] and x != y:
            n["n_edit_edit"] += 1
        elif x != base[c] or y != base[c]:
            n["n_clean"] += 1
        state[c] = x if x != base[c] else y
    for kind in ("lines", "gaps"):
        for i in range(len(lines)):
            mine, theirs = i in a[kind], i in b[kind]
            if mine and theirs and a[kind][i] != b[kind][i]:
                drop = a[kind][i] is None or b[kind][i] is None
                n["n_insert_insert" if kind == "gaps" else "n_edit_delete" if drop else "n_edit_edit"] += 1
            elif mine or theirs:
                n["n_clean"] += 1
    return (doc_id, *show(state, b["lines"] | a["lines"], b["gaps"] | a["gaps"]), *[n[c] for c in COUNTS])


def plain(rows):
    rows = {(r[0], r[2] or "", r[3] or "", r[1] or "") for r in rows}
    out, added = [], {"L": {}, "R": {}}
    for doc_id, lang, source, text in rows:
        out.append(merged(doc_id, lang, source, text))
        for name, start in (("L", -1), ("R", -5)):
            k = code(name, doc_id, "row")
            if k in (3, 4):
                at, new = None if doc_id is None else start - doc_id, (lang, source, "!?"[k - 3])
                added[name][at] = min(added[name].get(at, new), new)
    for at in added["L"].keys() | added["R"].keys():
        x, y = added["L"].get(at), added["R"].get(at)
        clash = x is not None and y is not None and x != y
        lang, source, text = x or y
        out.append((at, lang, source, hashlib.sha256(text.encode()).hexdigest(), int(not clash), 0, 0, int(clash)))
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in branch_merge.merge(df).select("doc_id", "lang", "source", "text_sha256", *COUNTS).collect()), key=repr)


def test_merge_equals_plain(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs(spark, sf_dir).collect()]
    assert run(docs(spark, sf_dir)) == plain(rows)


def test_merge_many_small_documents(spark):
    """Enough ids for every pair of codes of rows, columns and lines, and for rows that both branches add."""
    rows = [(i, "\n".join(["a", "", "b"][: i % 4]), ("en", "", None)[i % 3], ("x", None)[i % 2]) for i in range(-300, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got, want = run(df), plain(rows)
    assert got == want
    assert all(sum(r[k] for r in got) > 0 for k in range(4, 8))


def test_merge_odd_rows(spark):
    rows = [r[:4] for r in ODD] + [(None, "no id\nline", "en", "a"), (None, "no id\nline", "en", "a"), (7, "same id, other text\n\n", "de", "b"), (2**63 - 1, "high", "en", "a"), (20, "\n" * 70000 + "end", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS key", "2 AS line", "3 AS row_l", "4 AS i", "5 AS head")
    want = [r for r in plain(rows) if r[0] is None or r[0] >= -(2**63)]
    assert run(df) == want
    assert run(df.limit(0)) == []


def test_added_rows_beyond_long_have_no_id(spark):
    high = next(i for i in range(2**63 - 1, 2**63 - 400, -1) if code("R", i, "row") in (3, 4) and -5 - i < -(2**63)) if any(code("R", i, "row") in (3, 4) for i in range(2**63 - 4, 2**63)) else None
    if high is not None:
        got = run(spark.createDataFrame([(high, "t", "en", "a")], "doc_id long, text string, lang string, source string"))
        assert [r[0] for r in got].count(None) == 1
