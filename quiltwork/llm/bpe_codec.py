"""BPE encoding and decoding of whole texts (see ``bpe`` for the method)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.llm import bpe
from quiltwork.llm.common import small_batches


def encode(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian unsigned 32-bit integers) of every whole text; a null text is empty.

    Rows are taken one by one: repeated rows and ids give repeated rows, an empty table gives none.
    """
    path = tokenizer or bpe.default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.load(path)
        for b in batches:
            ids = [codec.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``text`` for ``ids`` as ``encode`` returns them; null ids give an empty text."""
    path = tokenizer or bpe.default_path()
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.load(path)
        for b in batches:
            texts = [codec.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, and its ids are decoded again.

    A null text is empty and has no ids.  Texts of any length are taken whole, rows one by one (repeated ones and those
    without doc_id too); other columns are ignored; an empty table gives no rows.
    """
    path = tokenizer or bpe.default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.load(path)
        for b in batches:
            count, sha, back = [], [], []
            for text in b.column(1).to_pylist():
                ids = codec.encode(text or "")
                count.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(codec.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
