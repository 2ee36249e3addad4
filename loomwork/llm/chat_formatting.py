"""Operator 5, chat formatting: conversations into one string each, by columnar byte assembly.

A turn becomes ``<s>role\\ntext</s>\\n``. The texts of a batch stay one Arrow buffer: control strings are escaped by
Arrow's own string kernels, segment lengths (header, text, footer) give cumulative offsets, and numpy scatters the
bytes of headers, texts and footers into one preallocated buffer, which becomes the result's Arrow buffer. The loss
mask is a list of (start, end) code points per conversation: the texts of assistant turns.

Escaping puts a backslash behind the first character of a control string and doubles every backslash, so a formatted
text holds no control string but the template's, and ``unescaped`` gives the text back; a line break in a role, which
would end the header, becomes a backslash and n.

Defined results: null texts and roles are empty strings; turns of equal number go by role, then text; repeated rows
are turns of their own; a row without a conversation id is a conversation of its own; an empty table gives an
empty result; other columns are not read. A conversation is one record, so it is assembled by one task, whole however
long its texts are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import shipped, table

OPEN, CLOSE, LOSS_ROLE = "<s>", "</s>\n", "assistant"
#: Strings that a text must not hold as they are, each by its first character and the rest.
CONTROL = r"([<\[])(/?s>|/?INST\]|<SYS>>|</SYS>>)"
FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.large_string()), ("n_turns", pa.int64()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
#: Bytes of text that are scattered at a time; a longer conversation makes a batch of its own.
BATCH_BYTES = 4_000_000


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.replace_substring(texts, "\\", "\\\\"), CONTROL, r"\1\\\2")


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"\\": "\\", "n": "\n"}.get(m[1], ""), text) if "\\" in text else text


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy segment i of data to place to[i], all segments at once."""
    lengths = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(to - offsets[:-1], lengths)] = data


def assembled(rows: pa.Table) -> pa.RecordBatch:
    """Whole conversations, sorted, to a batch of FORMATTED."""
    text, role = (escaped(pc.fill_null(rows.column(c).combine_chunks().cast(pa.large_string()), "")) for c in ("text", "role"))
    role = pc.replace_substring(role, "\n", "\\n")
    head = pc.binary_join_element_wise(pa.scalar(OPEN, pa.large_string()), role, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    (hd, ho), (td, to), (fd, _) = raw(head), raw(text), raw(pa.array([CLOSE]))
    lengths = np.diff(ho) + np.diff(to) + len(fd)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(begins[-1], np.uint8)
    scatter(out, begins[:-1], hd, ho)
    scatter(out, begins[:-1] + np.diff(ho), td, to)
    scatter(out, begins[1:] - len(fd), np.tile(fd, len(text)), np.arange(len(text) + 1) * len(fd))
    ids = rows.column("conv_id").combine_chunks()
    keys, missing = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | missing[1:] | missing[:-1]])
    edges = np.r_[first, len(text)]
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(begins[edges].astype(np.int64).tobytes()), pa.py_buffer(out))
    # The same offsets in code points give the loss mask.
    hc, tc = (pc.utf8_length(x).to_numpy(zero_copy_only=False) for x in (head, text))
    chars = np.concatenate([[0], np.cumsum(hc + tc + len(CLOSE))])
    starts = chars[:-1] + hc - np.repeat(chars[first], np.diff(edges))
    loss = pc.fill_null(pc.equal(rows.column("role").combine_chunks(), LOSS_ROLE), False).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(loss)])[edges].astype(np.int32))
    spans = [pa.ListArray.from_arrays(offsets, pa.array(x[loss].astype(np.int64))) for x in (starts, starts + tc)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), formatted, pa.array(np.diff(edges).astype(np.int64)), *spans], schema=FORMATTED)


def _assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the sorted rows between conversations; what a batch leaves open waits for the next one."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        for k in range(0, len(batch), 1000):
            part = pa.Table.from_batches([batch.slice(k, 1000)])
            ids = part.column("conv_id").to_pylist()
            cut = next((i for i in range(len(ids) - 1, 0, -1) if ids[i] is None or ids[i] != ids[i - 1]), None)
            if cut is None and held and (ids[0] is None or held[-1].column("conv_id")[-1].as_py() != ids[0]):
                cut = 0
            if cut is not None and size + part.nbytes > BATCH_BYTES:
                held.append(part.slice(0, cut))
                yield assembled(pa.concat_tables(held))
                held, size, part = [], 0, part.slice(cut)
            held.append(part)
            size += part.nbytes
    if held:
        yield assembled(pa.concat_tables(held))


def chat_formatted(df: DataFrame) -> DataFrame:
    """conv_id, formatted, n_turns, loss_starts, loss_ends (code points) from rows of conv_id, turn, role, text."""
    shipped(df.sparkSession)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # Rows without an id go wherever there is room: they share no record.
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text", F.monotonically_increasing_id()))
    rows = rows.withColumn("lone", lone).repartition("conv_id", "lone").drop("lone").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_assemble, "conv_id long, formatted string, n_turns long, loss_starts array<long>, loss_ends array<long>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the formatted string alone."""
    turns = formatted.split(CLOSE)
    if turns.pop():
        raise ValueError("a turn does not end")
    return [tuple(unescaped(x) for x in t.removeprefix(OPEN).split("\n", 1)) for t in turns]  # type: ignore[misc]


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for conv, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends"))):
            turns = read_back(text)
            loss = "".join(unescaped(text[a:b]) for a, b in zip(starts, ends))
            rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings; digests are read back from the output."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_formatted(rows).mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_ESCAPED = "regexp_replace(replace({}, chr(92), chr(92) || chr(92)), '" + CONTROL + "', '\\1\\\\\\2', 'g')"
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = '{LOSS_ROLE}'), '') AS loss,
    CAST(sum({len(OPEN)} + length(role) + 1 + length({_ESCAPED.format("text")}) + {len(CLOSE)}) AS BIGINT) AS formatted_chars FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM c) GROUP BY conv_id, lone)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
