"""Exact substring deduplication by Rabin-Karp hashes of every fixed-length word window.

One pass hashes each window of each document with a polynomial rolling hash modulo
2^64 over 64-bit word hashes.  Within a block of documents equal hashes are combined
first: only the smallest document of a hash goes on, and the others are known to be
repeats.  The hashes are then dealt to buckets by their leading bits, where Spark
brings together what the blocks found, and every document that holds a hash also held
by a smaller document gets it back.  A second pass merges the repeated windows of a
document into maximal intervals and removes them.

A window in a third of all documents is one entry a block (a million words) in its
hash's bucket.  The windows already known to be repeats need not meet anything: each
block deals them to buckets of its own choice, so a hot passage's repeats spread over all
of them.  Hashes are sorted and stored plane by plane, so the shuffle's codec shortens
their leading bytes.  With n windows the chance of any false match is about n*n / 2^65.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from repolytics.llm.common import release_memory, sized_partitions, words_of

WIDTH = 13
BLOCK_WORDS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    """XXH64 of words, kept for words seen before, in bounded memory."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


def rolling(words: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Mixed Rabin-Karp hashes of all width-word windows of a sequence of word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.to(len(words))
    sums = np.cumsum(words * up, dtype=np.uint64)
    out = sums[width - 1 :].copy()
    out[1:] -= sums[: n - 1]
    out *= down[:n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _planes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


_DEALT = "bucket int, known boolean, hashes binary, owners binary"


def _deal(width: int, buckets: int):
    """Blocks of documents to sorted (hash, smallest document) runs, a row for each bucket."""

    def flush(block, powers):
        block.sort(key=lambda x: x[0])
        lengths = np.array([len(w) for _, w in block])
        hashes = rolling(np.concatenate([w for _, w in block]), width, powers)
        ends = np.cumsum(lengths)
        inside = np.ones(len(hashes), bool)
        for cut in range(1, width):  # windows that would run into the next document
            inside[(at := ends[:-1] - cut)[at < len(hashes)]] = False
        owners = np.repeat(np.array([d for d, _ in block], np.int64), lengths)[: len(hashes)][inside]
        hashes = hashes[inside]
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        fresh = np.r_[True, hashes[1:] != hashes[:-1]]
        again = ~fresh & np.r_[False, owners[1:] != owners[:-1]]
        least = owners[fresh][np.cumsum(fresh) - 1] if len(hashes) else owners
        again &= owners != least
        turn = xxhash.xxh64_intdigest(block[0][0].to_bytes(8, "little", signed=True) + len(owners).to_bytes(8, "little")) % buckets
        for known, part in ((False, fresh), (True, again)):
            h, d = hashes[part], owners[part]
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            if known:  # they meet nothing there: every block turns them by another amount
                bucket = (bucket + turn) % buckets
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(h) else []
            rows = [(int(bucket[a]), known, _planes(h[a:b]), _planes(d[a:b].view(np.uint64))) for a, b in zip(cuts, [*cuts[1:], len(h)])]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 64]), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["bucket", "known", "hashes", "owners"])

    def run(batches):
        of, powers, block, size = WordHashes(), Powers(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = words_of(text)
                    if len(words) >= width:
                        block.append((doc, np.fromiter(map(of.__getitem__, words), np.uint64, len(words))))
                        size += len(words)
                        if size >= BLOCK_WORDS:
                            yield from flush(block, powers)
                            block, size = [], 0
        if block:
            yield from flush(block, powers)
        del of, block
        release_memory()

    return run


def _count(table: pa.Table) -> pa.Table:
    """(doc_id, hash) of each window in a bucket that a smaller document holds as well."""
    known = table.column("known").to_pylist()
    hashes = [_unplanes(x) for x in table.column("hashes").to_pylist()]
    owners = [_unplanes(x).view(np.int64) for x in table.column("owners").to_pylist()]
    out = [(o, h) for k, h, o in zip(known, hashes, owners) if k]
    if fresh := [i for i, k in enumerate(known) if not k]:
        h, o = np.concatenate([hashes[i] for i in fresh]), np.concatenate([owners[i] for i in fresh])
        order = np.argsort(h, kind="stable")
        h, o = h[order], o[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        least = np.repeat(np.minimum.reduceat(o, starts), np.diff(np.r_[starts, len(h)]))
        out.append((o[o > least], h[o > least]))
    docs, found = (np.concatenate([x[i] for x in out]) for i in (0, 1))
    release_memory()
    return pa.table({"doc_id": pa.array(docs.astype(np.int64)), "hash": pa.array(found.astype(np.uint64).view(np.int64))})


def dealt_windows(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = 1 << 20) -> DataFrame:
    """bucket, known, hashes, owners: what the blocks found of all windows of docs."""
    buckets = sized_partitions(docs, bucket_bytes, least=64, most=1 << 22)
    return docs.select("doc_id", "text").mapInArrow(_deal(width, buckets), _DEALT)


def repeated_windows(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, hash of every window whose words also start in a smaller document."""
    return dealt_windows(docs, width, bucket_bytes).groupBy("bucket").applyInArrow(_count, "doc_id long, hash long")


def covered(text: str | None, hashes, width: int, of: WordHashes, powers: Powers) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and which of them a window with one of these hashes covers."""
    words = words_of(text)
    cover = np.zeros(len(words) + 1, np.int64)
    if hashes is not None and len(words) >= width:
        own = rolling(np.fromiter(map(of.__getitem__, words), np.uint64, len(words)), width, powers)
        hit = np.flatnonzero(np.isin(own, np.asarray(hashes, np.int64).view(np.uint64)))
        cover[hit] += 1
        np.subtract.at(cover, hit + width, 1)
    return words, np.cumsum(cover)[: len(words)] > 0


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a mask, as [start, end) pairs."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text less its words in these spans and the white space before each of them."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : ends[a - 1][1] if a else 0])
        at = ends[b - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass").strip(" \t\n\v\f\r")


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _remove(width: int, texts: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        of, powers = WordHashes(), Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, rows = batch.slice(at, 128), []
                for doc, text, hashes in zip(*(part.column(i).to_pylist() for i in range(3))):
                    words, mask = covered(text, hashes, width, of, powers)
                    spans = spans_of(mask)
                    kept = words if not spans else [w for w, m in zip(words, mask.tolist()) if not m]
                    rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in spans], (without(text, spans) if spans else text) if texts else None))
                columns = list(zip(*rows))
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], kind)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
                if texts:
                    arrays, names = [*arrays, pa.array(columns[5], pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def deduplicate(docs: DataFrame, width: int = WIDTH, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (of removed words), kept_text if asked.

    A word goes where a window of width words covers it whose words also start in a
    document with a smaller doc_id.  Null and empty texts have no words (and the hash of
    the empty string); rows that repeat a doc_id do not repeat each other's windows, but
    each gets its row; rows without a doc_id lose nothing and take nothing from others, as
    no id is smaller or larger than none; an empty table gives an empty result; further
    columns of docs are not looked at.
    """
    docs = docs.select("doc_id", "text")
    found = repeated_windows(docs.filter("doc_id is not null"), width).groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    joined = docs.join(found, "doc_id", "left").select("doc_id", "text", "hashes")
    return joined.mapInArrow(_remove(width, texts), _RESULT + (", kept_text string" if texts else ""))


def _clean(width: int, names: list[str]):
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        of, powers = WordHashes(), Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts, keep = part.column(text_at).to_pylist(), []
                for i, hashes in enumerate(part.column(len(names)).to_pylist()):
                    if hashes is not None:
                        _, mask = covered(texts[i], hashes, width, of, powers)
                        if mask.any():
                            texts[i] = "" if mask.all() else without(texts[i], spans_of(mask))
                            if mask.all():
                                continue
                    keep.append(i)
                columns = list(part.columns[: len(names)])
                columns[text_at] = pa.array(texts, pa.string())
                if chars_at >= 0:
                    before = part.column(chars_at).to_pylist()
                    old = part.column(text_at).to_pylist()
                    columns[chars_at] = pa.array([b if o == t else len(t) for b, o, t in zip(before, old, texts)], part.column(chars_at).type)
                yield pa.RecordBatch.from_arrays(columns, names).take(pa.array(keep, pa.int32()))

    return run


def cleaned_rows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated passages cut from text (and n_chars set anew).

    A row all of whose words go is left out; every other row stays, rows without a
    doc_id or text as they are.
    """
    found = repeated_windows(docs.filter("doc_id is not null"), width).groupBy("doc_id").agg(F.collect_set("hash").alias("removed_hashes"))
    found = found.withColumnRenamed("doc_id", "removed_id")
    joined = docs.join(found, docs["doc_id"] == found["removed_id"], "left").drop("removed_id")
    names = docs.columns
    return joined.select(*names, "removed_hashes").mapInArrow(_clean(width, names), docs.schema)


#: DuckDB SQL for the rows of the query.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM d WHERE len(ws) >= 13),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM w JOIN m USING (g) WHERE doc_id > least),
u AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
t AS (SELECT u.rid, string_agg(word, ' ' ORDER BY u.p) AS kept, count(*) AS n FROM u ANTI JOIN c ON u.rid = c.rid AND u.p = c.p GROUP BY u.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (rid)
"""
