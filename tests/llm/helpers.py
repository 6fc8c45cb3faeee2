import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 4),
    (4, "one", "en", None, 3),
    (5, "one", "en", "b", 3),
    (6, "ONE two", "de", "b", 7),
    (7, "one TWO", "de", "b", 7),
    (8, "word " * 3000, "en", "b", 15000),
    (9, "12345 !!! --", "en", "b", 12),
    (10, "a b c d e f g h i j k l m n o p", "en", "b", 31),
    (10, "a b c d e f g h i j k l m n o p", "en", "b", 31),
    (11, "x" * 50000, "fr", "b", 50000),
    (12, "\u00e9\u00e8 \U0001f642 \u65e5\u672c\u8a9e <|endoftext|> it's 3\u00b2", "fr", "b", 30),
    (13, "# * $ % & | < >" * 40, "fr", "b", 30),
    (14, "the line\nthe line\n\nthe line\nother line", "en", "b", 30),
]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text, fold=True):
    return WORD.findall(lower(text or "") if fold else (text or ""))


def odd_docs(spark, clash=True):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        for c in ("n", "size", "shard", "id", "band", "cid", "length", "piece", "root", "stratum", "score", "bands", "_text", "block"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def docs(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
