"""Token ids in Arrow files of fixed-size lists.

Documents in ascending doc_id order are dealt to shards by ranges.  Each shard is an
Arrow stream in the file format: a batch's column `ids` is a fixed-size list of
`length` ids (16 bits wide where the vocabulary allows) and `mask` a fixed-size list of
booleans that is false on padding, so any sequence of a memory-mapped file is a view
without a copy.  Only a shard's last sequence is padded.  Beside it a second Arrow file
lists the shard's documents (doc_id, start in the shard, n_tokens).

A task writes under a name of its own and the manifest lists what succeeded, so lost
executors and repeated attempts leave no doubt about which files count.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from repolytics.llm.common import is_local, local_path, new_folder, sized_partitions
from repolytics.llm.tokens import END_ID, TOKENIZER, encoder

LENGTH = 2048


def make_folder(uri: str) -> None:
    if is_local(uri):
        import os

        os.makedirs(local_path(uri), exist_ok=True)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path)


def open_sink(uri: str):
    if is_local(uri):
        return pa.OSFile(local_path(uri), "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path)


def open_source(uri: str):
    """Random access to a file; a memory map where the folder is a mounted one."""
    if is_local(uri):
        return pa.memory_map(local_path(uri))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def open_sequences(uri: str) -> pa.Table:
    """The sequences of a shard: ids and mask, memory-mapped where possible."""
    return pa.ipc.open_file(open_source(uri)).read_all()


class _Writer:
    """Fills equal-length sequences and writes them a batch at a time."""

    def __init__(self, uri: str, length: int, dtype, batch_rows: int = 256):
        self._length, self._dtype, self._each = length, np.dtype(dtype), batch_rows * length
        self._schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self._dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self._sink = open_sink(uri)
        self._file = pa.ipc.new_file(self._sink, self._schema)
        self._held, self._n = [], 0

    def add(self, ids: np.ndarray) -> None:
        self._held.append(ids.astype(self._dtype))
        self._n += len(ids)
        if self._n >= self._each:
            every = np.concatenate(self._held)
            whole = len(every) // self._length * self._length
            for at in range(0, whole, self._each):
                self._write(every[at : min(at + self._each, whole)], None)
            self._held, self._n = [every[whole:].copy()], len(every) - whole

    def _write(self, ids: np.ndarray, real: int | None) -> None:
        mask = np.ones(len(ids), bool)
        if real is not None:
            mask[real:] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self._length) for x in (ids, mask)]
        self._file.write_batch(pa.record_batch(lists, schema=self._schema))

    def close(self) -> None:
        rest = np.concatenate(self._held) if self._held else np.zeros(0, self._dtype)
        if len(rest):
            self._write(np.r_[rest, np.zeros(-len(rest) % self._length, self._dtype)], len(rest))
        self._file.close()
        self._sink.close()


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "shard int, path string, first_doc long, n_docs long, n_tokens long"


def _write(folder: str, length: int, name: str, path: str | None):
    def run(batches):
        encode, writer, index, held, total, docs, first = encoder(name, path), None, None, [], 0, 0, None
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if writer is None:
                        shard = TaskContext.get().partitionId()
                        target = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
                        writer = _Writer(target, length, np.uint16 if encode.size <= 1 << 16 else np.uint32)
                        sink = open_sink(target + ".docs")
                        index, first = pa.ipc.new_file(sink, _DOCS), doc
                    ids = np.frombuffer(encode.ids(text) + end, "<u4")
                    writer.add(ids)
                    held.append((doc, total, len(ids)))
                    total, docs = total + len(ids), docs + 1
                    if len(held) == 8192:
                        index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held)], schema=_DOCS))
                        held = []
        if writer is not None:
            if held:
                index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held)], schema=_DOCS))
            writer.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([target]), *(pa.array([v], pa.int64()) for v in (first, docs, total))], ["shard", "path", "first_doc", "n_docs", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, length: int = LENGTH, tokenizer: str = TOKENIZER, path: str | None = None, shard_bytes: int = 8 << 20) -> DataFrame:
    """Write the ids of all texts, in doc_id order; gives the manifest (a row for each shard).

    The manifest has shard, path, first_doc, n_docs, n_tokens and base, the ids in all
    shards before.  Null and empty texts are the end id alone; repeated rows are written
    as often as they occur; rows without a doc_id come first and keep the null; an empty
    table writes no shard; further columns of docs are not looked at.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    make_folder(folder)
    texts = docs.select("doc_id", "text")
    shards = sized_partitions(texts, shard_bytes)
    dealt = texts.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_write(folder, length, tokenizer, path), _MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _read(batches):
    for batch in batches:
        for target, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = pa.ipc.open_file(open_source(target))
            flat = pa.chunked_array([rows.get_batch(i).column(0).flatten() for i in range(rows.num_record_batches)])
            index = pa.ipc.open_file(open_source(target + ".docs"))
            for i in range(index.num_record_batches):
                docs = index.get_batch(i)
                starts, sizes = (docs.column(c).to_numpy() for c in (1, 2))
                crcs = [zlib.crc32(flat.slice(a, n).to_numpy().astype("<u4").tobytes()) for a, n in zip(starts.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + base), docs.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""
    shards = max(1, manifest.count())
    return manifest.select("path", "base").repartition(shards).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
