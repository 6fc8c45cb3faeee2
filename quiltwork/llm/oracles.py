"""SQL forms of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

from quiltwork.llm.quality_rules import RULES

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Every pair of documents that share a shingle is counted, and links are followed from document to document.
NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(_FOLD)} AS l FROM documents),
 g AS (SELECT DISTINCT doc_id, CASE WHEN len(l) = 1 THEN l[1] ELSE l[i] || ' ' || l[i + 1] END AS s FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l), 2))) AS i FROM w WHERE len(l) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node AND r.root < s.b)
 SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id, m.root = d.doc_id AS kept
 FROM documents d JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def quality_rules(risk: float = 0.05, level: float = 0.05, cost: float = 20.0) -> str:
    """The counts, the base rule and the risk-controlled cutoffs; the binomial tail is summed from log-gammas."""
    share = risk / len(RULES)
    ratio = {r: f"coalesce({top} / nullif(CAST({bottom} AS DOUBLE), 0), 0e0)" for r, (top, bottom, _) in RULES.items()}
    grid = " UNION ALL ".join(f"SELECT lang, '{r}' AS rule, {float(c)!r}e0 AS cut, CAST(sum(CASE WHEN quality = 1 AND {ratio[r]} > {float(c)!r}e0 THEN 1 ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN quality = 0 AND {ratio[r]} > {float(c)!r}e0 THEN 1 ELSE 0 END) AS BIGINT) AS caught, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM j GROUP BY lang" for r, (_, _, cuts) in RULES.items() for c in cuts)
    over = " OR ".join(f"coalesce({ratio[r]} > (SELECT cut FROM b WHERE b.rule = '{r}' AND b.lang = m.lang), FALSE)" for r in RULES)
    count = "length(t) - length(translate(t, '{}', ''))"
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')")} AS l FROM documents),
 x AS (SELECT doc_id, i, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] || ' ' || l[i + 3] || ' ' || l[i + 4] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 3)) AS i FROM d WHERE len(l) >= 5)),
 y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM x),
 z AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM y WHERE k > 1) GROUP BY doc_id),
 v AS (SELECT *, list_filter(string_split(t, chr(10)), lambda q: length(regexp_replace(q, '[\\x20\\x09-\\x0D]+', '', 'g')) > 0) AS lines FROM d),
 m AS (SELECT v.doc_id, lang, CAST(len(l) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST({count.format('#*$%&|<>')} AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(z.n, 0) AS BIGINT) AS n_repeat_words, CAST({count.format('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} AS BIGINT) AS n_capitals, CAST({count.format('!')} AS BIGINT) AS n_shouts FROM v LEFT JOIN z ON z.doc_id = v.doc_id),
 q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
 j AS (SELECT m.*, q.quality FROM m JOIN q ON q.doc_id = m.doc_id),
 g AS ({grid}),
 u AS (SELECT *, (SELECT count(DISTINCT lang) FROM j) AS strata FROM g WHERE lost <= n * {share!r}e0 AND caught > lost * {cost!r}e0),
 o AS (SELECT u.lang, u.rule, u.cut, u.lost, u.caught, u.strata, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}e0) + (n - i) * ln(1 - {share!r}e0))) AS tail FROM (SELECT *, unnest(range(0, lost + 1)) AS i FROM u) u GROUP BY ALL),
 b AS (SELECT lang, rule, cut FROM (SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY caught - lost * {cost!r}e0 DESC, cut DESC) AS k FROM o WHERE tail <= {level!r}e0 / (strata * {len(RULES)})) WHERE k = 1)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ({over}) AS kept FROM m"""


#: The exact answer; the graphs give the same on tables whose shards a search walks through in full.
ANN = """WITH v AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
 u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM u q JOIN u c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
 SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20"""

#: Each document meets each order; the first failing step decides.
FILTER_AUDIT = f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')")} AS l FROM documents),
 m AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT w.part, coalesce(m.good, FALSE) AS good, coalesce(m.toxic, FALSE) AS toxic,
   concat(CASE WHEN len(l) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(l)) < 80 * len(l) THEN 'B' END,
    CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails
   FROM w LEFT JOIN m ON m.doc_id = w.doc_id),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
 o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
 p AS (SELECT f.*, filter_order, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: contains(fails, filter_order[i]))), 6) AS first FROM f, o),
 s AS (SELECT p.*, step, contains(fails, filter_order[step]) AS failed FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
 g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (failed AND first < step) AS redundant,
  count(*) FILTER (fails = filter_order[step]) AS unique_fails, count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost FROM s GROUP BY ALL)
 SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM g"""


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def branch_merge() -> str:
    """Both branches by unit, the checksum folded byte by byte (the names are ASCII)."""
    fold = f"lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1])"
    code = lambda branch, name: f"(xor(list_reduce(list_transform(string_split(concat('{branch}:', doc_id, ':', {name}), ''), lambda q: CAST(ord(q) AS BIGINT)), {fold}, CAST(4294967295 AS BIGINT)), 4294967295) % 17)"
    edit = lambda v, k: f"CASE {k} WHEN 0 THEN '' WHEN 1 THEN {v} || '!' WHEN 2 THEN {v} || '?' ELSE {v} END"
    pick = lambda v: f"CASE WHEN gone THEN NULL WHEN rr = 0 THEN {v}_l WHEN {v}_l <> {v} THEN {v}_l ELSE {v}_r END"
    both = lambda v: f"({v}_l <> {v} AND {v}_r <> {v} AND {v}_l <> {v}_r)"
    one = lambda v: f"(({v}_l <> {v} OR {v}_r <> {v}) AND NOT {both(v)})"
    return f"""WITH b AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 k AS (SELECT *, {code("L", "'row'")} AS rl, {code("R", "'row'")} AS rr, {code("L", "'lang'")} AS ll, {code("R", "'lang'")} AS lr, {code("L", "'source'")} AS sl, {code("R", "'source'")} AS sr FROM b),
 e AS (SELECT *, {edit("lang", "ll")} AS lang_l, {edit("lang", "lr")} AS lang_r, {edit("source", "sl")} AS source_l, {edit("source", "sr")} AS source_r FROM k),
 y AS (SELECT doc_id, rr, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM k),
 z AS (SELECT *, {code("L", "i")} AS cl, {code("R", "i")} AS cr FROM y),
 u AS (SELECT doc_id, i, rr, line, FALSE AS gap, CASE WHEN cl < 3 THEN cl END AS l, CASE WHEN cr < 3 THEN cr END AS r FROM z UNION ALL SELECT doc_id, i, rr, line, TRUE, CASE WHEN cl IN (3, 4) THEN cl END, CASE WHEN cr IN (3, 4) THEN cr END FROM z),
 v AS (SELECT *, CASE WHEN rr = 0 THEN l ELSE coalesce(l, r) END AS s FROM u),
 t AS (SELECT doc_id, string_agg(CASE WHEN gap THEN CASE s WHEN 3 THEN '!' ELSE '?' END WHEN s IS NULL THEN line WHEN s = 1 THEN line || '!' ELSE line || '?' END, chr(10) ORDER BY i, gap) FILTER (CASE WHEN gap THEN s IS NOT NULL ELSE s IS NULL OR s > 0 END) AS text,
   count(*) FILTER ((l IS NOT NULL OR r IS NOT NULL) AND coalesce(l = r, TRUE)) AS clean, count(*) FILTER (l <> r AND NOT gap AND l > 0 AND r > 0) AS ee, count(*) FILTER (l <> r AND NOT gap AND (l = 0 OR r = 0)) AS ed, count(*) FILTER (l <> r AND gap) AS ii, bool_or(l IS NOT NULL) AS by_l, bool_or(r IS NOT NULL) AS by_r FROM v GROUP BY doc_id),
 j AS (SELECT e.* EXCLUDE (text), coalesce(t.text, '') AS text, clean, ee, ed, ii, by_l OR lang_l <> lang OR source_l <> source AS touched_l, by_r OR lang_r <> lang OR source_r <> source AS touched_r FROM e JOIN t ON t.doc_id = e.doc_id),
 h AS (SELECT *, rl = 0 OR rr = 0 AS drops, (rl = 0 AND rr <> 0 AND touched_r) OR (rr = 0 AND rl <> 0 AND touched_l) AS fight, rl = 0 OR (rr = 0 AND NOT touched_l) AS gone FROM j),
 a AS (SELECT -1 - doc_id AS doc_id, 0 AS side, lang, source, CASE rl WHEN 3 THEN '!' ELSE '?' END AS text FROM k WHERE rl IN (3, 4) UNION ALL SELECT -5 - doc_id, 1, lang, source, CASE rr WHEN 3 THEN '!' ELSE '?' END FROM k WHERE rr IN (3, 4)),
 n AS (SELECT doc_id, arg_min(lang, side) AS lang, arg_min(source, side) AS source, arg_min(text, side) AS text, count(DISTINCT (lang, source, text)) AS kinds FROM a GROUP BY doc_id)
 SELECT doc_id, {pick("lang")} AS lang, {pick("source")} AS source, CASE WHEN NOT gone THEN sha256(text) END AS text_sha256,
  CAST(CASE WHEN drops THEN CASE WHEN fight THEN 0 ELSE 1 END ELSE clean + CASE WHEN {one("lang")} THEN 1 ELSE 0 END + CASE WHEN {one("source")} THEN 1 ELSE 0 END END AS BIGINT) AS n_clean,
  CAST(CASE WHEN drops THEN 0 ELSE ee + CASE WHEN {both("lang")} THEN 1 ELSE 0 END + CASE WHEN {both("source")} THEN 1 ELSE 0 END END AS BIGINT) AS n_edit_edit,
  CAST(CASE WHEN drops THEN CASE WHEN fight THEN 1 ELSE 0 END ELSE ed END AS BIGINT) AS n_edit_delete, CAST(CASE WHEN drops THEN 0 ELSE ii END AS BIGINT) AS n_insert_insert FROM h
 UNION ALL SELECT doc_id, lang, source, sha256(text), CAST(CASE WHEN kinds = 1 THEN 1 ELSE 0 END AS BIGINT), 0, 0, CAST(CASE WHEN kinds = 1 THEN 0 ELSE 1 END AS BIGINT) FROM n"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": NEAR_DEDUP, "op2_ann": ANN, "op4_quality_rules": quality_rules(), "op12_branch_merge": branch_merge(), "op13_filter_audit": FILTER_AUDIT}
