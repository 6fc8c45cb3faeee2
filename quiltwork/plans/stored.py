"""Queries over files and versions that they write themselves, from the tables' rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quiltwork.plans.registry import layers, query
from quiltwork.sources import bundle, dictionaries, synth
from quiltwork.sources.scratch import shared_folder


@query(
    """SELECT CASE r_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'pl' ELSE 'de' END AS lang, n_name AS key, CASE WHEN r_regionkey = 0 THEN 'new ' ELSE '' END || r_name AS text
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3 AND NOT (r_regionkey = 0 AND n_nationkey % 2 = 1)"""
)
def dictionary_files(spark, sf_dir):
    """Dictionaries of five languages as files: one replaced by a newer file, one broken, one a list."""
    c = F.col
    path = f"{shared_folder(spark)}/dictionaries-{uuid.uuid4().hex}"
    words = synth.read(spark, sf_dir, "nation").join(synth.read(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    code = F.element_at(F.array(*map(F.lit, ("en", "pl", "de", "fr", "it"))), c("r_regionkey") + 1)
    words = words.select(code.alias("lang"), c("n_name").alias("key"), c("r_name").alias("text"), "n_nationkey")
    dictionaries.save(words.where("lang <> 'it'").drop("n_nationkey"), path)
    newer = words.where("lang = 'en' AND n_nationkey % 2 = 0").select("lang", "key", F.concat(F.lit("new "), "text").alias("text"))
    dictionaries.save(newer, path)
    broken = words.groupBy("lang").agg(F.max("key").alias("key")).where("lang IN ('fr', 'it')")
    broken = broken.select("lang", F.when(c("lang") == "fr", F.concat(F.lit('{"'), "key", F.lit('": "cut off'))).otherwise(F.concat(F.lit('["'), "key", F.lit('"]'))).alias("value"))
    broken.repartition("lang").write.mode("append").partitionBy("lang").text(path)
    return dictionaries.load(spark, path)


@query(
    f"""{layers('t')}, v AS (SELECT * FROM (VALUES (1, 1e0), (2, 19.9125e0), (3, 19.9045e0), (4, 19.9125e0)) v(version, east)), b AS (SELECT version, ord, CASE WHEN version = 1 THEN maxx ELSE least(maxx, east) END - minx AS w, maxy - miny AS h FROM t CROSS JOIN v)
    SELECT version, CAST(count(*) AS BIGINT) AS territories, CAST(floor(sum(w * h) * 1e10 + 0.5e0) AS BIGINT) AS ground, CAST(floor((CASE WHEN version = 1 THEN 19.92001e0 WHEN version = 3 THEN 19.9045e0 ELSE 19.9125e0 END - 19.9e0) * 1e6 + 0.5e0) AS BIGINT) AS width FROM b WHERE w > 0 GROUP BY version"""
)
def bundle_versions(spark, sf_dir):
    """Boundary and territories changed together twice and taken back once: what each version holds."""
    store = bundle.Bundle(spark, f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}")
    t = synth.territories(spark, sf_dir)
    store.push(outer=spark.range(1).selectExpr("19.92001D AS east"), board=t)
    for east in (19.9125, 19.9045):
        store.push(outer=spark.range(1).select(F.lit(east).alias("east")), board=t.withColumn("maxx", F.least("maxx", F.lit(east))).where("maxx > minx"))
    store.restore(2)
    out = None
    for v in store.versions():
        board = store.read("board", v).agg(F.count("*").alias("territories"), F.floor(F.sum(F.expr("(maxx - minx) * (maxy - miny)")) * 1e10 + 0.5).alias("ground"))
        row = board.crossJoin(F.broadcast(store.read("outer", v).select(F.floor((F.col("east") - 19.9) * 1e6 + 0.5).alias("width")))).select(F.lit(v).alias("version"), "territories", "ground", "width")
        out = row if out is None else out.union(row)
    return out
