"""Three-way merge of two branches of a table of documents, in SQL functions only.

What a branch does to a unit (a row, a column, a line, the gap after a line) follows from a checksum of the branch's
name, the document's id and the unit's name, so both branches are derived and merged side by side: lines and gaps are
exploded with their places, CASE rules merge each unit, and the units of a row are put together again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes modulo ``MODULUS``: what a branch does to a unit.
MODULUS = 17
DROP, SHOUT, ASK, SHOUT_AFTER, ASK_AFTER = range(5)
#: A branch's added row has the id ``ADDED[branch] - doc_id``.
ADDED = {"L": -1, "R": -5}


def _code(branch: str, name: Column) -> Column:
    return (F.crc32(F.concat(F.lit(f"{branch}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), name)) % MODULUS).cast("int")


def _edited(value: Column, code: Column) -> Column:
    return F.when(code == DROP, "").when(code == SHOUT, F.concat(value, F.lit("!"))).when(code == ASK, F.concat(value, F.lit("?"))).otherwise(value)


def _columns(df: DataFrame) -> DataFrame:
    """``df`` with codes of the row and the merged columns: ``<name>_l``, ``<name>_m``, and what has changed."""
    c = F.col
    df = df.withColumns({"row_l": _code("L", F.lit("row")), "row_r": _code("R", F.lit("row"))})
    for name in ("lang", "source"):
        df = df.withColumns({f"{name}_l": _edited(c(name), _code("L", F.lit(name))), f"{name}_r": _edited(c(name), _code("R", F.lit(name)))})
        left, right = c(f"{name}_l") != c(name), c(f"{name}_r") != c(name)
        clash = left & right & (c(f"{name}_l") != c(f"{name}_r"))
        df = df.withColumns({f"{name}_m": F.when(left, c(f"{name}_l")).otherwise(c(f"{name}_r")), f"{name}_clash": clash, f"{name}_clean": (left | right) & ~clash, f"{name}_by_l": left, f"{name}_by_r": right})
    return df


def _units(base: DataFrame) -> DataFrame:
    """A row a line, and a row a gap that a branch fills: its place, its merged text and what it counts."""
    c = F.col
    lines = base.select("doc_id", "lang", "source", "key", _code("L", F.lit("row")).alias("row_l"), _code("R", F.lit("row")).alias("row_r"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.withColumns({"code_l": _code("L", c("i").cast("string")), "code_r": _code("R", c("i").cast("string"))})
    inside = lambda side: F.when(c(f"code_{side}") <= ASK, c(f"code_{side}"))
    after = lambda side: F.when((c(f"code_{side}") == SHOUT_AFTER) | (c(f"code_{side}") == ASK_AFTER), c(f"code_{side}"))
    unit = lambda gap, of: F.struct(F.lit(gap).alias("gap"), of("l").alias("l"), of("r").alias("r"))
    units = lines.select("doc_id", "lang", "source", "key", "row_l", "row_r", "i", "line", F.inline(F.array(unit(False, inside), unit(True, after))))
    units = units.where(~c("gap") | c("l").isNotNull() | c("r").isNotNull())
    both = c("l").isNotNull() & c("r").isNotNull() & (c("l") != c("r"))
    touched = c("l").isNotNull() | c("r").isNotNull()
    # where R drops the row and L keeps it, L's state stands
    state = F.when(c("row_r") == DROP, c("l")).otherwise(F.coalesce("l", "r"))
    mark = F.when(state.isin(SHOUT, SHOUT_AFTER), "!").otherwise("?")
    text = F.when(c("gap"), F.when(state.isNotNull(), mark)).when(state.isNull(), c("line")).when(state != DROP, F.concat("line", mark))
    return units.select(
        "doc_id", "lang", "source", "key",
        (~c("gap") & (c("i") == 0)).alias("head"),
        F.when(text.isNotNull(), F.struct((c("i").cast("long") * 2 + c("gap").cast("int")).alias("at"), text.alias("text"))).alias("piece"),
        (touched & ~F.coalesce(both, F.lit(False))).alias("clean"),
        (both & ~c("gap") & (c("l") != DROP) & (c("r") != DROP)).alias("edit_edit"),
        (both & ~c("gap") & ((c("l") == DROP) | (c("r") == DROP))).alias("edit_delete"),
        (both & c("gap")).alias("insert_insert"),
        c("l").isNotNull().alias("by_l"),
        c("r").isNotNull().alias("by_r"),
    )


def _kept_rows(base: DataFrame) -> DataFrame:
    """The rows of the table itself, merged."""
    c = F.col
    kinds = ("clean", "edit_edit", "edit_delete", "insert_insert")
    sums = [F.sum(F.when(c(k), 1).otherwise(0)).alias(k) for k in (*kinds, "head")]
    rows = _units(base).groupBy("doc_id", "lang", "source", "key").agg(F.collect_list("piece").alias("pieces"), *sums, F.max("by_l").alias("by_l"), F.max("by_r").alias("by_r"))
    # equal rows come together here: each unit is then counted as often as there are rows
    rows = rows.withColumns({k: F.expr(f"{k} div head") for k in kinds})
    rows = _columns(rows)
    by = {side: c(f"by_{side}") | c(f"lang_by_{side}") | c(f"source_by_{side}") for side in "lr"}
    gone_l, gone_r = c("row_l") == DROP, c("row_r") == DROP
    dropped, fight = gone_l | gone_r, (gone_l & ~gone_r & by["r"]) | (gone_r & ~gone_l & by["l"])
    absent = gone_l | (gone_r & ~by["l"])
    # sorted, a unit's pieces stand together, one for each equal row: every ``head``-th is taken
    once = F.filter(F.array_sort("pieces"), lambda p, i: i % c("head") == 0)
    text = F.concat_ws("\n", F.transform(once, lambda p: p["text"]))
    value = lambda name: F.when(~absent, F.when(gone_r, c(f"{name}_l")).otherwise(c(f"{name}_m")))
    one = lambda flag: F.when(flag, 1).otherwise(0)
    whole = lambda kind, alone: F.when(dropped, alone).otherwise(kind).cast("long")
    return rows.select(
        "doc_id",
        value("lang").alias("lang"),
        value("source").alias("source"),
        F.when(~absent, F.sha2(text, 256)).alias("text_sha256"),
        whole(c("clean") + one(c("lang_clean")) + one(c("source_clean")), one(~fight)).alias("n_clean"),
        whole(c("edit_edit") + one(c("lang_clash")) + one(c("source_clash")), F.lit(0)).alias("n_edit_edit"),
        whole(c("edit_delete"), one(fight)).alias("n_edit_delete"),
        whole(c("insert_insert"), F.lit(0)).alias("n_insert_insert"),
    )


def _added_rows(base: DataFrame) -> DataFrame:
    """The rows that the branches add, merged by id and value."""
    c = F.col
    sides = []
    for branch, start in ADDED.items():
        code = _code(branch, F.lit("row"))
        new = base.where(code.isin(SHOUT_AFTER, ASK_AFTER)).select(
            F.try_subtract(F.lit(start).cast("long"), c("doc_id")).alias("doc_id"),
            F.struct("lang", "source", F.when(code == SHOUT_AFTER, "!").otherwise("?").alias("text")).alias("new"),
        )
        sides.append(new.select("doc_id", *[(c("new") if b == branch else F.lit(None)).cast("struct<lang:string,source:string,text:string>").alias(b) for b in ADDED]))
    met = sides[0].unionByName(sides[1]).groupBy("doc_id").agg(F.min("L").alias("l"), F.min("R").alias("r"))
    clash = F.coalesce(c("l") != c("r"), F.lit(False))
    new = F.coalesce("l", "r")
    count = lambda flag: F.when(flag, 1).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    return met.select(
        "doc_id", new["lang"].alias("lang"), new["source"].alias("source"), F.sha2(new["text"], 256).alias("text_sha256"),
        count(~clash).alias("n_clean"), zero.alias("n_edit_edit"), zero.alias("n_edit_delete"), count(clash).alias("n_insert_insert"),
    )


def merge(docs: DataFrame) -> DataFrame:
    """Every id that the table or a branch has: the merged row's lang, source and text_sha256, and the counts.

    An absent row (dropped by the merge) has nulls for these three.  Null texts and columns are empty; an empty text
    is one empty line; a text all of whose lines are dropped is empty.  Texts of any length are merged whole, a row's
    lines in one group.  Rows equal in doc_id, lang, source and text count once; rows that share only the doc_id are
    merged each for itself.  A row without doc_id goes by an empty id in its units' names; what such rows add has no
    id either and is one row.  Of several rows that one branch adds under one id the least (lang, source, text)
    counts.  An added row whose id the table has too is a row of its own.  An id beyond the range of long is null.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in docs.columns else F.lit("")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    return _kept_rows(base.withColumn("key", F.unhex(F.sha2("text", 256)))).unionByName(_added_rows(base))
