"""A table dealt to files in hash order, whose schemas drifted, and their rewrite to one schema.

Rows are sorted by the crc32 of their id without a global sort: a histogram over the high
bits of the crc has a fixed number of buckets, its exclusive prefix sums say where a bucket
starts, and a row number within the bucket does the rest.  Ids that hold more than a
thousandth of all rows number fewer than a thousand; their rows are counted by value before
they are shuffled and cut into cells by a hash, so that no id is one task's, and a cell
starts where the prefix sums say.

A file's number follows from the rank.  Rows are shuffled by it, sorted within it, and
grouped applyInArrow writes each file as a stream of batches; a second one reads a file,
matches its columns by Parquet field id and writes it anew.  Files carry names of their own
for every attempt; a checkpointed manifest says which count, and only then are the others
deleted, so a lost executor leaves the starting files as they were.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from repolytics.llm.common import checkpointed, is_local, local_path, new_folder
from repolytics.llm.tokenfiles import make_folder, open_sink, open_source

FILES = 250
BITS = 14
SALT_BITS = 6
MOST_HEAVY = 1_000
SEED = 19

#: The evolved schema: name, Spark type, Arrow type; the Parquet field ids are 1, 2, 3 ...
COLUMNS = (
    ("client_id", "long", pa.int64()), ("master_id", "long", pa.int64()), ("source", "string", pa.string()), ("updated_at", "timestamp_ntz", pa.timestamp("us")),
    ("name", "string", pa.string()), ("email", "string", pa.string()), ("city", "string", pa.string()), ("nation_id", "long", pa.int64()), ("segment", "string", pa.string()), ("balance", "double", pa.float64()),
)
NAMES = [name for name, _, _ in COLUMNS]
ID = {name: at + 1 for at, name in enumerate(NAMES)}
#: What a column is in every row of a file that lacks it.
MISSING = {ID["nation_id"]: -1, ID["segment"]: "none"}
SWAPPED, REVERSED, LACKING, NARROW = 1, 2, 4, 8


def version_of(file_no: int, seed: int = SEED) -> int:
    found = zlib.crc32(f"{seed}:{file_no}".encode()) % 24
    return found if found <= 15 else 0


def drifted(version: int) -> list[tuple[int, str, pa.DataType]]:
    """Field id, name and type of each column of a starting file, in its order."""
    fields = [(ID[name], name, kind) for name, _, kind in COLUMNS]
    if version & LACKING:
        fields = [f for f in fields if f[0] not in MISSING]
    if version & SWAPPED:
        other = {"name": "email", "email": "name"}
        fields = [(i, other.get(name, name), kind) for i, name, kind in fields]
    if version & NARROW:
        narrow = {ID["balance"]: pa.float32(), ID["nation_id"]: pa.int32()}
        fields = [(i, name, narrow.get(i, kind)) for i, name, kind in fields]
    return [fields[0], *reversed(fields[1:])] if version & REVERSED else fields


def schema_of(fields: list[tuple[int, str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(name, kind, metadata={b"PARQUET:field_id": str(i).encode()}) for i, name, kind in fields])


def _hashed(rows: DataFrame) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("client_id").cast("string"), F.lit("")).cast("binary"))
    return rows.select(*(F.col(name).cast(kind).alias(name) for name, kind, _ in COLUMNS)).withColumn("crc", crc).withColumn("bucket", F.shiftright("crc", 32 - BITS).cast("int"))


def _place() -> Column:
    """Where a row stands in its bucket; rows without an id come first at their crc."""
    return F.struct(F.col("crc").alias("crc"), F.col("client_id").isNotNull().alias("known"), F.coalesce("client_id", F.lit(0).cast("long")).alias("id"))


def _heavy_ids(rows: DataFrame, crowded: list[int], total: int) -> list:
    """bucket, place of the ids that hold more than a thousandth of all rows."""
    some = rows.filter(F.col("bucket").isin(crowded)).groupBy("bucket", _place().alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return some.filter(F.col("n") * MOST_HEAVY > total).select("bucket", "place").collect()


def ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """The evolved columns with rank (from 0) and copies of every row, and how many rows there are.

    A row stands for `copies` equal rows at the ranks from its own on; copies is 1 but for
    ids that hold more than a thousandth of all rows.  Rows of one id come in an order that
    a hash of their values and then the values fix.
    """
    spark, rows = rows.sparkSession, _hashed(rows)
    found = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most 2^BITS rows
    bucket, n = (found.column(c).to_numpy() for c in ("bucket", "n"))
    total = int(n.sum())
    crowded = bucket[n * MOST_HEAVY > total].tolist()
    heavy = sorted(_heavy_ids(rows, crowded, total)) if crowded else []
    tie = F.xxhash64(*NAMES)
    before = Window.partitionBy("bucket", "part", "salt").orderBy("place", "tie", *NAMES)
    rows = rows.withColumn("place", _place())
    if not heavy:
        light = rows.withColumns({"part": F.lit(0), "salt": F.lit(0), "tie": tie, "copies": F.lit(1).cast("long")})
        cells = [(int(b), 0, 0, int(x)) for b, x in zip(bucket, n)]
        parts = [light.withColumn("in_cell", F.row_number().over(before).cast("long") - 1)]
    else:
        by_bucket: dict[int, list] = {}
        for b, place in heavy:
            by_bucket.setdefault(b, []).append(place)
        of = spark.createDataFrame(list(by_bucket.items()), "heavy_bucket int, heavies array<struct<crc: long, known: boolean, id: long>>")
        rows = rows.join(F.broadcast(of), F.col("bucket") == F.col("heavy_bucket"), "left").drop("heavy_bucket")
        lower, same = F.filter("heavies", lambda x: x < F.col("place")), F.exists("heavies", lambda x: x == F.col("place"))
        rows = rows.withColumn("part", F.coalesce(2 * F.size(lower) + same.cast("int"), F.lit(0))).drop("heavies")
        light = rows.filter("part % 2 = 0").withColumns({"salt": F.lit(0), "tie": tie, "copies": F.lit(1).cast("long")})
        many = rows.filter("part % 2 = 1").groupBy("bucket", "part", "crc", "place", *NAMES).agg(F.count(F.lit(1)).alias("copies"))
        many = checkpointed(many.withColumn("tie", tie).withColumn("salt", (F.shiftright("tie", 64 - SALT_BITS) + (1 << (SALT_BITS - 1))).cast("int")))
        few = light.filter(F.col("bucket").isin(sorted(by_bucket))).select("bucket", "part", "salt", "copies")
        counted = few.union(many.select("bucket", "part", "salt", "copies")).groupBy("bucket", "part", "salt").agg(F.sum("copies").alias("n")).collect()
        cells = [(int(b), 0, 0, int(x)) for b, x in zip(bucket, n) if b not in by_bucket] + [tuple(r) for r in counted]
        running = F.sum("copies").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
        parts = [light.withColumn("in_cell", F.row_number().over(before).cast("long") - 1), many.withColumn("in_cell", running)]
    cells.sort()
    starts = np.r_[0, np.cumsum([c[3] for c in cells], dtype=np.int64)[:-1]] if cells else np.zeros(0, np.int64)
    own = pa.table({"of_bucket": pa.array([c[0] for c in cells], pa.int32()), "of_part": pa.array([c[1] for c in cells], pa.int32()), "of_salt": pa.array([c[2] for c in cells], pa.int32()), "start": pa.array(starts, pa.int64())})
    at = F.broadcast(spark.createDataFrame(own))
    placed = [p.join(at, (p["bucket"] == at["of_bucket"]) & (p["part"] == at["of_part"]) & (p["salt"] == at["of_salt"])).select(*NAMES, (F.col("start") + F.col("in_cell")).alias("rank"), "copies") for p in parts]
    return (placed[0] if len(placed) == 1 else placed[0].unionByName(placed[1])), total


def by_file(rows: DataFrame, each: int) -> DataFrame:
    """rows (of ranked) with file_no; equal rows that stand in several files are a row in each."""
    first, last = F.expr(f"rank div {each}"), F.expr(f"(rank + copies - 1) div {each}")
    spread = rows.select("*", F.explode(F.sequence(first, last)).alias("file_no"))
    start = F.greatest(F.col("rank"), F.col("file_no") * each)
    end = F.least(F.col("rank") + F.col("copies"), (F.col("file_no") + 1) * each)
    return spread.select("file_no", *NAMES, start.alias("rank"), (end - start).alias("copies"))


def _repeated(batch: pa.RecordBatch, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """A batch's rows as often as copies says, in batches of bounded size."""
    copies = batch.column("copies").to_numpy()
    if (copies == 1).all():
        yield batch
        return
    ends = np.cumsum(copies)
    for at in range(0, int(ends[-1]), most):
        yield batch.take(pa.array(np.searchsorted(ends, np.arange(at, min(at + most, int(ends[-1]))), side="right")))


_STARTED = "file_no long, version int, n_rows long, path string"


def _write_start(folder: str, seed: int):
    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no = key[0].as_py()
        version = version_of(file_no, seed)
        fields = drifted(version)
        schema, path, n, last = schema_of(fields), f"{folder}/start-{file_no:05d}-{uuid.uuid4().hex}.parquet", 0, -1
        with open_sink(path) as sink, pq.ParquetWriter(sink, schema) as out:
            for batch in batches:
                ranks = batch.column("rank").to_numpy()
                if len(ranks) and (ranks[0] <= last or (np.diff(ranks) <= 0).any()):
                    raise ValueError(f"the rows of file {file_no} are not in order")
                last = int(ranks[-1]) if len(ranks) else last
                for part in _repeated(batch):
                    columns = [part.column(NAMES[i - 1]).cast(kind, safe=not pa.types.is_floating(kind)) for i, _, kind in fields]
                    out.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
                    n += part.num_rows
        yield pa.RecordBatch.from_pydict({"file_no": [file_no], "version": pa.array([version], pa.int32()), "n_rows": [n], "path": [path]})

    return write


def write_start(rows: DataFrame, total: int, folder: str, files: int = FILES, seed: int = SEED) -> DataFrame:
    """file_no, version, n_rows, path of the starting files, one written by each group."""
    each = 1 + total // files
    dealt = by_file(rows, each).repartition(max(1, -(-total // each)), "file_no").sortWithinPartitions("file_no", "rank")
    return dealt.groupBy("file_no").applyInArrow(_write_start(folder, seed), _STARTED)


def _field_ids(schema: pa.Schema) -> dict[int, int]:
    """Field id to the place of its column."""
    return {int((field.metadata or {})[b"PARQUET:field_id"]): at for at, field in enumerate(schema)}


def evolved(batch: pa.RecordBatch, at: dict[int, int], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of a starting file by the evolved schema: columns matched by field id, cast, or filled where the file lacks them."""
    columns = [batch.column(at[ID[f.name]]).cast(f.type) if ID[f.name] in at else pa.array([MISSING[ID[f.name]]], f.type).take(pa.array(np.zeros(batch.num_rows, np.int64))) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _texts(column: pa.Array, name: str) -> pa.Array:
    if name == "updated_at":
        column = column.cast(pa.int64())
    elif name == "balance":
        scaled = pc.floor(pc.multiply(column, 1048576.0))
        if bool(pc.all(pc.less(pc.abs(scaled), 2.0**62)).as_py() in (True, None)):
            column = scaled.cast(pa.int64())
        else:  # beyond 64 bits, and what is no number
            column = pa.array([None if x is None else str(math.floor(x)) if math.isfinite(x) else str(x) for x in scaled.to_pylist()], pa.string())
    return pc.fill_null(column.cast(pa.string()), "?")


class Digest:
    """Counts and hashes over the batches of a file."""

    def __init__(self):
        self.rows = self.nulls = 0
        self._ids, self._rows = hashlib.sha256(), hashlib.sha256()

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        texts = [_texts(batch.column(name), name) for name in NAMES]
        lines = pc.binary_join_element_wise(*texts, "|")
        for into, parts, sign in ((self._ids, texts[0], ","), (self._rows, lines, "\n")):
            into.update(((sign if self.rows else "") + sign.join(parts.to_pylist())).encode())
        self.rows += batch.num_rows
        self.nulls += sum(c.null_count for c in batch.columns)

    def row(self) -> dict:
        return {"n_rows": [self.rows], "n_nulls": [self.nulls], "ids_sha256": [self._ids.hexdigest()], "rows_sha256": [self._rows.hexdigest()]}


_FINAL = "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"


def _rewrite(folder: str):
    schema = schema_of(drifted(0))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                path, version = one["path"], one["version"]
                with open_source(path) as source:
                    before = pq.ParquetFile(source)
                    start_columns = before.schema_arrow.names
                    if version:
                        at = _field_ids(before.schema_arrow)
                        path = f"{folder}/final-{one['file_no']:05d}-{uuid.uuid4().hex}.parquet"
                        with open_sink(path) as sink, pq.ParquetWriter(sink, schema) as out:
                            for part in before.iter_batches():
                                out.write_batch(evolved(part, at, schema))
                digest = Digest()
                with open_source(path) as source:
                    after = pq.ParquetFile(source)
                    columns = after.schema_arrow.names
                    for part in after.iter_batches():
                        digest.add(part)
                if digest.rows != one["n_rows"]:
                    raise ValueError(f"{path} has {digest.rows} rows instead of {one['n_rows']}")
                own = {"file_no": [one["file_no"]], "version": [version]} | digest.row()
                yield pa.RecordBatch.from_pydict(own | {"start_columns": [",".join(start_columns)], "columns": [",".join(columns)], "path": [local_path(path) if is_local(path) else path], "rewritten": [version != 0]})

    return run


def _kept_alone(spark: SparkSession, folder: str, paths: list[str]) -> None:
    """Delete what the folder holds beside these files; their number is bounded by that of the files."""
    names = {p.rpartition("/")[2] for p in paths}
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.listStatus(root):
        if found.getPath().getName() not in names:
            store.delete(found.getPath(), True)


def rewrite(started: DataFrame, folder: str, files: int) -> DataFrame:
    """The final files of a folder from the starting files (file_no, version, n_rows, path) in it."""
    return started.repartition(max(1, files), "file_no").groupBy("file_no").applyInArrow(_rewrite(folder), _FINAL)


def evolve(clients: DataFrame, folder: str | None = None, files: int = FILES, seed: int = SEED) -> DataFrame:
    """Write a table's starting files into a new folder, rewrite them there, and describe the final files.

    Returns file_no, version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns,
    columns, path, rewritten.  Null values stay null; rows without a client_id have the crc
    of an empty text and come first at it; repeated rows are rows of their own; rows that
    repeat a client_id stand in an order that their values decide; balances that are no
    number are written as `nan`, `inf` or `-inf` in the digest; texts of any length are
    kept; an empty table gives no file and an empty result; further columns are left out.
    """
    spark = clients.sparkSession
    folder = folder or new_folder(spark, "drift")
    make_folder(folder)
    rows, total = ranked(clients)
    each = 1 + total // files
    started = checkpointed(write_start(rows, total, folder, files, seed))
    final = checkpointed(rewrite(started, folder, -(-total // each)))
    _kept_alone(spark, folder, [r["path"] for r in final.select("path").collect()])
    return final
