"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column called ``name``, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text); other columns, whatever their names, take no part."""
    return docs.select(
        named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")
    )


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``n``."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Each text; null is empty."""
    return [x or "" for x in column.to_pylist()]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer file is; every worker asks its own installation."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
