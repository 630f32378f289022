"""Token ids of a corpus, in wavelet matrix shards."""

from __future__ import annotations

import math
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import shared_dir, ship, tidy, written
from .encode import encoder, with_end
from .wavelet import WaveletMatrix, build

#: Tokens after which a task begins the next shard; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 21
#: Bytes of text that are split at a time: a word that comes often in them is looked up once.
SLICE = 16 << 20
#: Shards that a task reads back, as a task takes about as long to begin as to read one.
READ = 4
#: Stands for a null id in the files; an id may not be the least of all longs.
NO_ID = -(1 << 63)
#: UTF-8 bytes of text of a write task, at least; of larger inputs a task has more, so that tasks grow as their root.
TASK_BYTES = 32 << 20
#: Tasks up to which each has TASK_BYTES.
TASKS = 4096


def _fs(uri: str):
    """A file system and the path in it: of ``file:`` and of whatever pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri:
        path = uri.removeprefix("file:")
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Writes a file under another name first, so that a reader or a second attempt never meets half of it."""
    f, path = _fs(uri)
    f.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with f.open_output_stream(part) as out:
        out.write(data)
    f.move(part, path)


def get(uri: str) -> bytes:
    f, path = _fs(uri)
    with f.open_input_stream(path) as src:
        return src.read()


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes shards of ascending ids to ``folder`` and returns their manifest: path, first_id, part, no, docs, tokens.

    A task has one range of ids and writes a shard at a time, named after its range and number: a task that runs
    again writes the same files.  Null text is empty and still has the end id.  Null ids come first.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, math.ceil(size / TASK_BYTES))
    if parts > TASKS:
        parts = math.ceil(math.sqrt(parts * TASKS))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())

    def work(batches):
        enc, no = encoder(tokenizer), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush():
            nonlocal held, count, no
            ids = np.concatenate([h[1] for h in held])
            lens = np.concatenate([h[2] for h in held])
            names = np.concatenate([h[0] for h in held])
            path = f"{folder}/part-{part:06d}-{no:05d}.wvm"
            put(path, build(ids, names, np.cumsum(lens)))
            row = pa.record_batch({"path": [path], "first_id": pa.array([int(names[0])], pa.int64()), "part": pa.array([part], pa.int32()), "no": pa.array([no], pa.int32()), "docs": pa.array([len(names)], pa.int64()), "tokens": pa.array([len(ids)], pa.int64())})
            held, count, no = [], 0, no + 1
            return row

        part = 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            names = b.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, ids, counts in enc.encode(b.column("text"), SLICE):
                ids, edge = with_end(ids, counts, end_id)
                a = 0
                while a < len(counts):
                    room = max(0, shard_tokens - count)
                    z = max(a + (not held), int(np.searchsorted(edge, edge[a] + room, side="right")) - 1)
                    if z > a:
                        held.append((names[i + a : i + z], ids[edge[a] : edge[z]], np.diff(edge[a : z + 1])))
                        count += int(edge[z] - edge[a])
                        a = z
                    if a < len(counts):
                        yield flush()
        if held:
            yield flush()

    schema = "path string, first_id long, part int, no int, docs long, tokens long"
    return written(rows.mapInArrow(tidy(work), schema), "manifest")


def read_token_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document, from the files: id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    ship(spark)
    # a few rows for each shard: the running sum over shards is a window over these alone
    w = Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    placed = written(placed.select("path", "base"), "shards")
    tasks = max(1, min(math.ceil(placed.count() / READ), 100_000))

    def work(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                m = WaveletMatrix(get(path))
                ids, ends = m.tokens().astype("<u4"), m.ends
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch({"id": pa.array(m.doc_ids, mask=m.doc_ids == NO_ID), "start": pa.array(starts + base), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64())})

    out = placed.repartition(tasks, "path").mapInArrow(tidy(work), "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32.

    Null texts are empty.  Null ids come first and stay null.  An empty table writes no file and gives no rows; rows
    that repeat an id are documents of their own.
    """
    folder = f"{shared_dir(docs.sparkSession)}/tokens"
    return read_token_shards(write_token_shards(docs, folder, tokenizer, end_id, id_col, text_col), id_col)
