"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folder of the public vocabulary files; every tokenizer operator takes it as a parameter.
TOKENIZER_DIR = os.environ.get("PUBLIC_TOKENIZERS", "")

#: Rows of one Arrow batch. Long documents make wide rows, so batches stay short.
BATCH_ROWS = 1000

#: Bytes of a piece in which long texts are read: lists of words take many times the bytes of the text.
PIECE = 1 << 20


def tokenizer_path(name: str, folder: str = TOKENIZER_DIR) -> str:
    """Place of a vocabulary file: in ``folder``, else where the installed package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """The session's Arrow batches get BATCH_ROWS rows at most. Every operator here asks for the same, so plans that run later get it, too; a smaller choice of the caller's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if not 0 < held <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names: other columns can't clash and are never read."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of each text, None for null."""
    return column.cast(pa.large_binary()).to_pylist()


def pieces_of(text: bytes, cut: re.Pattern[bytes], size: int = PIECE) -> Iterator[bytes]:
    """The whole text in pieces of ``size`` bytes and what is left up to the next match of ``cut``, which begins the next piece."""
    start = 0
    while len(text) - start > size:
        found = cut.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose per-task state comes from ``make()``; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or make()
                yield step(batch)

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """The rows of df, with all their columns, for whose texts (bytes, None for null) the function of ``make()`` says True.

    Verdict and row stay together: nothing is joined, so null or repeated ids and columns of any name do no harm.
    """
    at, names = df.columns.index(text_col), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = None
        for batch in batches:
            if batch.num_rows:
                test = test or make()
                texts = batch.column(at)
                kept = batch.filter(pa.array(test(as_bytes(texts if pa.types.is_string(texts.type) else texts.cast(pa.string()))), pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns, names)

    short_batches(df.sparkSession)
    # mapInArrow looks columns up by name, and would take a dot in one for a field of a struct
    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, df.schema)
