"""What the operators of this subpackage share: tables, free column names, bounded text slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.storage import dropped, shared_dir, stored
from loomwork.sources.workers import shipped

__all__ = ["by_text", "dropped", "record_batches", "shared_dir", "shipped", "slices", "stored", "table", "unused"]

#: Characters of text that one numpy pass holds at a time.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """name, made longer until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of a batch, of about SLICE_CHARS each; null is read as the empty text.
    A text is never cut: a longer one makes a slice of its own."""
    texts = batch.column(column)
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)) if pa.types.is_string(texts.type) and len(texts) else None
    first = total = 0
    for i in range(len(texts)):
        size = int(sizes[i]) if sizes is not None else len(texts[i].as_py() or "")
        if i > first and total + size > SLICE_CHARS:
            yield first, i, ["" if t is None else t for t in texts.slice(first, i - first).to_pylist()]
            first, total = i, 0
        total += size
    if len(texts) > first:
        yield first, len(texts), ["" if t is None else t for t in texts.slice(first).to_pylist()]


def by_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that a per-text operator reads, whatever else the table holds."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def record_batches(make, schema: pa.Schema):
    """A function for mapInArrow from make(ids, texts) -> list of columns after the id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in slices(batch):
                columns = make(texts)
                ids = batch.column(0).slice(first, end - first)
                yield pa.RecordBatch.from_arrays([ids.cast(schema.field(0).type), *(pa.array(c, schema.field(k + 1).type) for k, c in enumerate(columns))], schema=schema)

    return run
