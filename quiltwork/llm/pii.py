"""Personal data in texts: labelers vote on candidate spans, their reliabilities are estimated, a classifier decides.

Candidates come from two sets of patterns: base patterns, whose valid matches always stand, and broad ones for the same
kinds in other writings (``name [at] host [dot] org``, cards of other lengths, telephone numbers without a plus,
defanged or long addresses).  Five labelers (pattern, checksum, gazetteer, context, neighbours) vote 1, 0 or abstain
on every candidate.  Expectation-maximisation over the counts of vote patterns estimates how far each labeler is to be
trusted for each kind; the expected labels train a logistic regression on the spans' features, and that decides on
the broad candidates.

All rows are handled by DataFrame functions.  The driver gets two tables of counts whose sizes depend on the numbers
of kinds, labelers and features alone: at most 4 x 3**5 vote patterns and 4 x 2**12 feature patterns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
_AT, _DOT = r"(?: ?[(\[{<]at[)\]}>] ?| at )", r"(?: ?[(\[{<]dot[)\]}>] ?| dot )"
#: (kind, base, pattern, what a text must hold for a match).  Repetitions are possessive where nothing could be given
#: back, so that long texts need no stack; a look-behind keeps a match from starting inside what one further left takes.
FINDERS = (
    ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", True, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    ("card", True, r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", r"[0-9][ -]?[0-9]"),
    ("phone", True, r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    ("email", False, rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++|{_AT.replace('| at ', '')}[a-z0-9-]++(?:\.[a-z0-9-]++)++|@[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++)", r"(?i)[(\[{<](?:at|dot)[)\]}>]| dot "),
    ("ip", False, r"(?<![0-9A-Za-z.:])(?:(?:[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))){3}[0-9]{1,3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]|[0-9][\[(](?:\.|dot)[\])][0-9]"),
    ("card", False, r"(?<![0-9A-Za-z])(?<![0-9][ ./-])[0-9](?:[ ./-]?[0-9]){12,18}+(?![0-9A-Za-z])(?![ ./-][0-9])", r"[0-9][ ./-]?[0-9]"),
    ("phone", False, r"(?<![0-9A-Za-z+])(?<![0-9][ ./-])\(?[0-9](?:[ ().-]{0,2}[0-9]){7,14}+(?![0-9A-Za-z])(?![ ./-][0-9])", r"[0-9][ ().-]{0,2}[0-9]"),
)
CONTEXT = 40

# Fixed values of the gazetteers and of the context labeler.
TOP_LEVEL = "com org net edu gov int info biz io co eu uk us ca au de fr es it nl be ch at pl pt se no dk fi ie cz ru jp cn in br mx ar kr za nz example test invalid".split()
CARD_NETWORKS = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14})$"
CALLING_CODES = r"^(?:1|7|2(?:0|7|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[0578][0-9])|9(?:[0-58]|[679][0-9]))[0-9]{4,}$"
SAYS_YES = {
    "email": "mail|contact|write to|reach|kontakt|schreib|courriel|contacter|correo|escrib",
    "ip": r"\bip\b|address|host|server|client|login|adresse|serveur|direcci|servidor",
    "card": r"card|visa|mastercard|amex|credit|debit|\bpan\b|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|cell|\bfax|whatsapp|sms|anruf|mobil|appel|portable|llam|m.vil",
}
SAYS_NO = r"version|\bv\.?\s*$|order|invoice|\bid\b|isbn|issn|token|\bsha|serial|\bdoi\b|page|price|total|rechnung|bestell|facture|pedido|[$€£]\s*$"

LABELERS = ("pattern", "checksum", "gazetteer", "context", "neighbours")
#: Pseudo-votes of each labeler before any data: how often it is right and wrong; a checksum hardly fails by chance.
PRIOR_RIGHT, PRIOR_WRONG = (2.0, 50.0, 2.0, 2.0, 2.0), (0.5, 0.1, 0.5, 0.5, 0.5)
FEATURES = ("canonical", "separated", "prefixed", "checksum", "known", "context_yes", "context_no", "glued_left", "glued_right", "ten_digits", "letters", "disguised")


def _found(text: Column) -> Column:
    """All matches of all finders, each with the length of the gap before it and with what stands around it."""

    def row(k: int):
        return lambda z, i: F.struct(F.lit(k).alias("finder"), i.alias("i"), z["h"].alias("surface"), z["a"]["gap"].cast("long").alias("gap"), z["a"]["left"].alias("left"), z["b"]["right"].alias("right"))

    out = []
    for k, (_, _, pattern, needs) in enumerate(FINDERS):
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.split(text, pattern)
        around = F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("left"), F.left(g, F.lit(2)).alias("right")))
        rows = F.transform(F.arrays_zip(hits.alias("h"), around.alias("a"), F.slice(around, F.lit(2), F.size(around)).alias("b")), row(k))
        # beyond the last match a gap is left
        rows = F.filter(rows, lambda r: r["surface"].isNotNull())
        out.append(F.when(F.contains(text, F.lit("@")) if needs == "@" else F.rlike(text, F.lit(needs)), rows))
    return F.concat(*[F.coalesce(r, F.array().cast("array<struct<finder:int,i:int,surface:string,gap:bigint,left:string,right:string>>")) for r in out])


def _digits(surface: Column) -> Column:
    return F.regexp_replace(surface, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substr(digits, n - i + 1, F.lit(1)).try_cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _seen(spans: DataFrame) -> DataFrame:
    """``spans`` with the facts that validity, votes and features are made of."""
    c = F.col
    kind = lambda k: c("kind") == KINDS.index(k)
    spans = spans.withColumns({"kind": F.element_at(F.array(*[F.lit(KINDS.index(f[0])) for f in FINDERS]), c("finder") + 1), "base": F.element_at(F.array(*[F.lit(f[1]) for f in FINDERS]), c("finder") + 1), "digits": _digits(c("surface"))})
    before = F.lower("left")
    yes = F.lit(False)
    for k, words in SAYS_YES.items():
        yes = yes | (kind(k) & F.rlike(before, F.lit(words)))
    end_of_name = F.lower(F.regexp_extract("surface", "(?<![A-Za-z0-9-])[A-Za-z0-9-]++$", 0))
    number = F.regexp_replace(F.regexp_replace("surface", r"^[^0-9+]", ""), "[^0-9]", "")
    abroad = F.rlike("surface", F.lit(r"^(?:\+|\(?00)"))
    facts = {
        "n": F.length("digits"),
        "luhn": kind("card") & F.length("digits").between(12, 19) & _luhn(c("digits")),
        "bytes": kind("ip") & F.rlike(F.regexp_replace("surface", r"[\[(](?:\.|dot)[\])]", "."), F.lit(rf"^(?:{_BYTE}(?:\.|$)){{4}}$")),
        "colons": F.contains("surface", F.lit(":")),
        "yes": yes,
        "no": F.rlike(before, F.lit(SAYS_NO)),
        "glued_left": F.rlike("left", F.lit(r"[\p{L}0-9_=/#$@:.-]$")),
        "glued_right": F.rlike("right", F.lit(r"^(?:[\p{L}0-9_=/@]|[.:-][\p{L}0-9])")),
        "abroad": abroad,
        "known": F.when(kind("email"), end_of_name.isin(*TOP_LEVEL))
        .when(kind("card"), F.rlike("digits", F.lit(CARD_NETWORKS)))
        .when(kind("phone"), abroad & F.rlike(F.when(F.startswith(c("surface"), F.lit("+")), number).otherwise(F.regexp_replace(number, "^00", "")), F.lit(CALLING_CODES)))
        .otherwise(~F.rlike("surface", F.lit(r"^(?:0|127|2[4-5][0-9])\b"))),
        "canonical": c("base")
        | kind("email")
        | kind("ip")
        | (kind("card") & F.rlike("surface", F.lit(r"^(?:[0-9]{13,19}|[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ ./-])[0-9]{6}\2[0-9]{4,5})$")))
        | (kind("phone") & F.rlike("surface", F.lit(r"^(?:\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}|\(?00[1-9][ ().0-9-]*|\(?0[1-9][0-9]{1,4}\)?[ .-][0-9][0-9 .-]*)$"))),
        "dated": kind("phone") & F.rlike("surface", F.lit(r"^(?:(?:1[89]|20)[0-9]{2}[-.]?[01][0-9][-.]?[0-3][0-9]|[0-3]?[0-9][.-][01]?[0-9][.-](?:1[89]|20)[0-9]{2})")),
    }
    return spans.withColumns(facts)


def _valid() -> Column:
    """Whether a base match counts."""
    c = F.col
    by_kind = {"email": F.lit(True), "ip": c("bytes"), "card": c("n").between(16, 19) & c("luhn"), "phone": c("n").between(8, 15)}
    out = F.lit(False)
    for k, good in by_kind.items():
        out = F.when(c("kind") == KINDS.index(k), good).otherwise(out)
    return out


def _votes() -> dict[str, Column]:
    """Each labeler's vote: 1 for personal data, 0 against, null for no opinion."""
    c = F.col
    kind = lambda k: c("kind") == KINDS.index(k)
    return {
        "pattern": F.when(c("dated"), 0).when(c("canonical"), 1).when(kind("card"), 0),
        "checksum": F.when(kind("card"), c("luhn").cast("int")).when(kind("ip") & ~c("colons"), c("bytes").cast("int")).when(kind("phone") & ~c("n").between(8, 15), 0),
        "gazetteer": F.when(kind("email") | kind("card"), c("known").cast("int")).when(kind("phone") & c("abroad"), c("known").cast("int")).when(kind("ip") & ~c("known"), 0),
        "context": F.when(c("yes") & ~c("no"), 1).when(c("no") & ~c("yes"), 0),
        "neighbours": F.when(c("glued_left") | c("glued_right"), 0),
    }


def _features() -> dict[str, Column]:
    c = F.col
    return {
        "canonical": c("canonical") & ~c("dated"),
        "separated": F.rlike("surface", F.lit(r"[ ()/-]")),
        "prefixed": c("abroad"),
        "checksum": c("luhn") | c("bytes"),
        "known": c("known"),
        "context_yes": c("yes"),
        "context_no": c("no"),
        "glued_left": c("glued_left"),
        "glued_right": c("glued_right"),
        "ten_digits": c("n") >= 10,
        "letters": F.rlike("surface", F.lit("[A-Za-z]")),
        "disguised": ~c("base") & (F.rlike("surface", F.lit(r"(?i)\bat\b|\bdot\b|[\[(]\.[\])]"))),
    }


def candidates(found: DataFrame) -> DataFrame:
    """The valid base spans, and broad ones that meet no base span, a row each.

    doc_id, key, kind, base, start, end, surface, ``votes`` (base 3, a digit a labeler: 0 against, 1 for, 2 none) and
    ``mask`` (a bit a feature).  Repeated rows of ``found`` count once.
    """
    c = F.col
    spans = found.where(c("finder").isNotNull()).repartition("doc_id", "key")
    one = Window.partitionBy("doc_id", "key", "finder")
    # of equal rows each match comes several times: sums run over all of them and are divided again
    spans = spans.withColumns(
        {
            "copies": F.sum(F.when(c("i") == 0, 1).otherwise(0)).over(one),
            "sum": F.sum(c("gap") + F.length("surface")).over(one.orderBy("i").rangeBetween(Window.unboundedPreceding, Window.currentRow)),
            "rank": F.row_number().over(one.orderBy("i")),
        }
    ).where((c("rank") - 1) % c("copies") == 0)
    spans = spans.withColumn("end", F.expr("sum div copies")).withColumn("start", c("end") - F.length("surface"))
    spans = _seen(spans).where(~c("base") | _valid())
    text = Window.partitionBy("doc_id", "key")
    so_far = lambda *order: text.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumns(
        {
            "base_until": F.max(F.when(c("base"), c("end"))).over(so_far("start", c("base").desc(), "finder")),
            "base_from": F.min(F.when(c("base"), c("start"))).over(so_far(c("start").desc(), c("base").desc(), "finder")),
        }
    )
    apart = F.coalesce(c("base_until") <= c("start"), F.lit(True)) & F.coalesce(c("base_from") >= c("end"), F.lit(True))
    code, mask = F.lit(0), F.lit(0)
    for k, v in enumerate(_votes().values()):
        code = code + F.coalesce(v, F.lit(2)) * 3**k
    for k, v in enumerate(_features().values()):
        mask = mask + F.when(v, 1 << k).otherwise(0)
    return spans.where(c("base") | apart).select("doc_id", "key", "kind", "base", "start", "end", "surface", code.alias("votes"), mask.alias("mask"))


def reliabilities(counts: np.ndarray, votes: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation for one kind over its vote patterns.

    ``counts``: how often each pattern occurs; ``votes``: its votes (0, 1, 2 for none), a row a pattern.  Returns
    P(vote | label) as (label, labeler, vote), the share of personal data, and each pattern's chance to be such.
    Pseudo-counts say that a labeler is right more often than wrong, which also settles which label is which.
    """
    right, wrong, silent = np.array(PRIOR_RIGHT), np.array(PRIOR_WRONG), np.ones(len(LABELERS))
    prior = np.stack([np.stack([right, wrong, silent], 1), np.stack([wrong, right, silent], 1)])
    shown = (votes[:, :, None] == np.arange(3)).astype(float)
    ballots = (votes == 1).sum(1) - (votes == 0).sum(1)
    chance = 1 / (1 + np.exp(-ballots.astype(float)))
    for _ in range(rounds):
        weight = np.stack([(1 - chance) * counts, chance * counts])
        table = np.einsum("lp,pjv->ljv", weight, shown) + prior
        table /= table.sum(2, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("pjv,ljv->lp", shown, np.log(table))
        chance = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log(1 - share) - np.log(share), -50, 50)))
    return table, float(share), chance


def train(features: np.ndarray, positive: np.ndarray, total: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps on expected labels, a row a feature pattern; the last weight is the bias."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = ridge / 10
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (positive - total * p) - keep * w
        bend = (x * (total * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(spans: DataFrame) -> dict[int, np.ndarray]:
    """Weights of the span classifier by kind, learned from the labelers' votes alone."""
    by_kind: dict[int, list] = {}
    for r in spans.groupBy("kind", "votes").count().orderBy("kind", "votes").collect():
        by_kind.setdefault(r["kind"], []).append((r["votes"], r["count"]))
    chances: dict[tuple[int, int], float] = {}
    for kind, rows in by_kind.items():
        codes, counts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        _, _, chance = reliabilities(counts, codes[:, None] // 3 ** np.arange(len(LABELERS)) % 3)
        chances |= {(kind, int(v)): float(p) for v, p in zip(codes, chance, strict=True)}
    if not chances:
        return {}
    size = 3 ** len(LABELERS)
    table = F.create_map(*[F.lit(x) for (kind, v), p in chances.items() for x in (kind * size + v, p)])
    expected = spans.withColumn("_chance", F.element_at(table, F.col("kind") * size + F.col("votes")))
    rows = expected.groupBy("kind", "mask").agg(F.sum("_chance").alias("positive"), F.count("*").alias("total")).orderBy("kind", "mask").collect()
    out = {}
    for kind in by_kind:
        own = [r for r in rows if r["kind"] == kind]
        masks = np.array([r["mask"] for r in own])
        bits = (masks[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)
        out[kind] = train(bits, np.array([r["positive"] for r in own]), np.array([r["total"] for r in own], float))
    return out


def _score(weights: dict[int, np.ndarray]) -> Column:
    out = F.lit(0.0)
    for kind, w in weights.items():
        total = F.lit(float(w[-1]))
        for k, v in enumerate(w[:-1]):
            total = total + F.when(F.col("mask").bitwiseAND(1 << k) != 0, float(v)).otherwise(0.0)
        out = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-total))).otherwise(out)
    return out


def find(docs: DataFrame, cut: float = 0.8) -> DataFrame:
    """doc_id and ``spans``: array of (kind, start, end, surface, base, score), by kind as in ``KINDS``, then start.

    Places are code points, the end is exclusive.  Base spans always stand; a broad candidate that meets none of them
    is added where the classifier's score is ``cut`` or more.  Spans of one kind don't overlap; those of different
    kinds may.  A null or empty text has none.  Texts of any length are searched whole.  One row for each row of
    ``docs``, also of those that repeat or have no doc_id; rows equal in doc_id and text teach the labelers once.
    Without candidates nothing is learned or added.  Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    c = F.col
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t")).withColumn("_f", _found(c("_t")))
    rows = rows.select("doc_id", F.when(F.size("_f") > 0, F.unhex(F.sha2("_t", 256))).alias("key"), F.posexplode_outer("_f").alias("place", "hit"))
    found = scratch.keep(rows.select("doc_id", "key", "place", "hit.*"))
    spans = scratch.keep(candidates(found))
    spans = spans.withColumn("score", _score(fit(spans))).where(c("base") | (c("score") >= cut))
    span = F.struct("kind", "start", "end", "surface", "base", "score")
    lists = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(span)).alias("list"))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform("list", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["surface"].alias("surface"), s["base"].alias("base"), s["score"].alias("score")))
    some = found.where(c("place") == 0).select(c("doc_id").alias("_id"), c("key").alias("_key"))
    some = some.join(lists, c("_id").eqNullSafe(c("doc_id")) & (c("_key") == c("key")), "left").select(c("_id").alias("doc_id"), shown.alias("spans"))
    rest = found.where(c("place").isNull()).select("doc_id")
    none = F.array().cast(some.schema["spans"].dataType)
    return some.select("doc_id", F.coalesce("spans", none).alias("spans")).unionByName(rest.select("doc_id", none.alias("spans")))
