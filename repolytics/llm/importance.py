"""Resampling of documents towards a target's word and word-pair distribution.

Features are runs of one and two words, hashed into buckets by crc32.  They are found
without a Python step for each word: the bytes of an Arrow UTF-8 buffer are classified by
a lookup table, word boundaries are where the class changes, and one table-driven crc is
advanced for all words of a block at once, a byte a step.  A pair's crc goes on from the
crc of its first word.

A bucket's gain is the log ratio of its share in the target and in the corpus, both over
all rows.  A document's score is its mean gain plus Gumbel noise that its doc_id fixes, so
the highest scores are a draw without replacement.  Scores are integers in a range that
does not grow with the table (noise spans 26,000 values, gains some ten thousands), so
ranks come from a histogram of scores and a row number within a score; noise spreads equal
texts, and no score holds more than a two-thousandth of many rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from repolytics.llm.common import checkpointed, release_memory

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
BLOCK_BYTES = 1 << 20  # texts classified at once; a longer text is a block of its own
BLOCK_WORDS = 1 << 18  # words whose crc advances at once
LONG = 64  # bytes of a word that advance with the others; zlib goes on for the rest


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)  # of lower-cased bytes: digits, letters and all of other scripts
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The crc states after each has read its own slice of data; all advance together."""
    order = np.argsort(-lengths, kind="stable")
    out, at, n = state[order], starts[order], lengths[order]
    alive = len(n) - np.cumsum(np.bincount(np.minimum(n, LONG), minlength=LONG + 1))
    for step in range(min(LONG, int(n[0]) if len(n) else 0)):
        k = int(alive[step])
        out[:k] = _CRC[(out[:k] ^ data[at[:k] + step]) & np.uint32(255)] ^ out[:k] >> np.uint32(8)
    for i in range(int(np.searchsorted(-n, -LONG, side="left"))):
        rest = data[at[i] + LONG : at[i] + n[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def word_spans(data: np.ndarray, firsts: np.ndarray, classes: np.ndarray = _INSIDE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes in which a text begins at each of firsts; classes tells which bytes are in words."""
    inside = classes[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[firsts] = True
    before, after = np.r_[False, inside], np.r_[inside, False]
    starts = np.flatnonzero(after & (~before | begins))
    ends = np.flatnonzero(before & (~after | begins))
    return starts, ends


def block_features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words of each text, then of every feature its text and bucket; texts lie between offsets."""
    data = _LOWER[data]
    starts, ends = word_spans(data, offsets[:-1])
    n_words = np.diff(np.searchsorted(starts, offsets))
    text = np.repeat(np.arange(len(n_words)), n_words)
    lengths, of, found = ends - starts, [], []
    for at in range(0, len(starts), BLOCK_WORDS):
        to = min(len(starts), at + BLOCK_WORDS + 1)  # the last word only ends a pair
        here = slice(at, min(to, at + BLOCK_WORDS))
        words = advanced(np.full(here.stop - at, 0xFFFFFFFF, np.uint32), data, starts[here], lengths[here])
        pairs = np.flatnonzero(text[at : to - 1] == text[at + 1 : to])
        state = words[pairs]
        state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ state >> np.uint32(8)
        state = advanced(state, data, starts[at + 1 + pairs], lengths[at + 1 + pairs])
        of += [text[here], text[at + pairs]]
        found += [~words % np.uint32(buckets), ~state % np.uint32(buckets)]
    none = np.zeros(0, np.int64)
    return n_words, np.concatenate([none, *of]), np.concatenate([none, *found]).astype(np.int64)


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """from row, to row, bytes and offsets of blocks of an Arrow string array, without copying its buffer."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, width, len(texts) + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _counted(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                total += np.bincount(block_features(data, offsets, buckets)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])
        release_memory()

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often the features of all texts (one column) fall into each bucket; a task adds up before anything is shuffled."""
    return texts.mapInArrow(_counted(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from the texts (one column) of both; two rows a bucket reach the driver, whatever the tables."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for into, texts in ((s, corpus), (t, target)):
        found = bucket_counts(texts, buckets).toArrow()
        into[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((y + 1.0) * all_s / ((x + 1.0) * all_t))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def _weighed(shared, buckets: int, names: list[str], at_text: int):
    def run(batches):
        gains = shared.value
        for batch in batches:
            words, features, weights = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for at, to, data, offsets in blocks(batch.column(at_text)):
                n_words, text, bucket = block_features(data, offsets, buckets)
                n = np.bincount(text, minlength=to - at)
                total = np.zeros(to - at, np.int64)
                np.add.at(total, text, gains[bucket])
                words[at:to], features[at:to], weights[at:to] = n_words, n, np.where(n, total // np.maximum(n, 1), 0)
            own = [batch.column(i) for i in range(batch.num_columns) if i != at_text]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (words, features, weights))], names)
        release_memory()

    return run


def noise(doc_id, seed: int) -> Column:
    """Gumbel noise in thousandths that the doc_id (null: empty) alone decides."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """docs without text, with n_words, n_features, weight and score of every row.

    docs: doc_id, text and what else is to be kept under names of its own.  target: text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bucket_gains(docs.select("text"), target.select("text"), buckets))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    added = [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]
    names = [f.name for f in [*kept, *added]]
    weighed = docs.mapInArrow(_weighed(shared, buckets, names, docs.columns.index("text")), T.StructType([*kept, *added]))
    return weighed.withColumn("score", F.col("weight") + noise("doc_id", seed))


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (of scored) with rank: 1, 2, 3 ... of the drawn, null of the others.

    Of the rows with least_words words or more, percent in a hundred (rounded down) with the
    highest scores are drawn, ties to the smaller doc_id (null last), then fewer features.
    """
    rows = checkpointed(rows)
    can = F.col("n_words") >= least_words
    found = rows.filter(can).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()  # as many rows as scores, a bounded range
    score, n = (found.column(c).to_numpy() for c in ("score", "n"))
    order = np.argsort(-score)
    score, n = score[order], n[order]
    before = np.r_[0, np.cumsum(n)]
    most = int(before[-1]) * percent // 100
    reached = before[:-1] < most
    if not reached.any():
        return rows.withColumn("rank", F.lit(None).cast("long"))
    starts = rows.sparkSession.createDataFrame(pa.table({"start_score": score[reached], "start": before[:-1][reached]}))
    lowest = int(score[reached][-1])
    near = can & (F.col("score") >= lowest)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features"))
    high = rows.filter(near).join(F.broadcast(starts), F.col("score") == F.col("start_score")).withColumn("rank", F.col("start") + place)
    high = high.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).select(*rows.columns, "rank")
    return high.unionByName(rows.filter(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs that are drawn, with all their columns.

    Null and empty texts have no word and are not drawn unless least_words is 0.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("drawn_row")
    rows = ranked(scored(docs.select("doc_id", "text", whole), target, seed, buckets), percent, least_words)
    return rows.filter("rank is not null").select("drawn_row.*")


def rank_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs.

    Null and empty texts have no features and weight 0; rows that repeat a doc_id are
    scored and drawn each by its own text; rows without a doc_id take the noise of an empty
    one and keep the null; an empty target gives the gains of no features at all; an empty
    table gives an empty result; of further columns none is looked at.  Very long texts are
    one block each, at some five times their size.
    """
    rows = ranked(scored(docs.select("doc_id", "text"), target, seed, buckets), percent, least_words)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH byte AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM range(256) AS r(i)),
every AS (SELECT 0 AS kind, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
d AS (SELECT kind, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM every),
f AS (SELECT kind, rid, unnest(w) AS f FROM d UNION ALL SELECT kind, rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
c AS (SELECT kind, rid, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM c)),
b AS (SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT),
 lambda x, y: xor(crc[(xor(x, y) & 255) + 1], x >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM h, byte),
x AS (SELECT kind, rid, bucket, sum(n) AS n FROM c JOIN b USING (f) GROUP BY ALL),
g AS (SELECT i AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM x WHERE kind = 0) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM x WHERE kind = 1) + 10000)::DOUBLE)))::BIGINT AS gain
 FROM range(10000) AS r(i) LEFT JOIN (SELECT bucket, sum(n) AS n FROM x WHERE kind = 0 GROUP BY 1) s ON s.bucket = i LEFT JOIN (SELECT bucket, sum(n) AS n FROM x WHERE kind = 1 GROUP BY 1) t ON t.bucket = i),
m AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM x JOIN g USING (bucket) WHERE kind = 0 GROUP BY rid),
p AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
 ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (rid) WHERE kind = 0),
o AS (SELECT doc_id, n_words, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM k
"""
