"""Links of documents by the Jaccard similarity of their sets of word shingles, exactly.

Fingerprints propose pairs (simhash), but no fingerprint radius holds every pair of a
given similarity.  An exact prefix filter proposes the rest: with the shingles of all
texts in one fixed order, rare ones first, two sets of similarity t share a shingle among
the first n - ceil(t n) + 1 of each, and at the first shingle they share enough must still
follow in both.  A sample of the documents tells which shingles are common; it decides the
order alone, and any order gives the same links.

The shingles at the front (keys) of a block of documents are sorted and dealt to buckets
by their leading bits.  A key that several documents of a block have goes to its bucket
once, so a key in a third of all documents is one entry a block there; what is left are the
keys that two or more different texts have.  Each key's texts are first linked to one text
in their middle.  Only texts of a key that are still in different components are compared
pair by pair, inside Spark's join and by 256 bits of parity, which differ in no more places
than the sets differ in shingles; so few pairs come out of a dense group, and none that is
similar is left out.  Of long texts so few bits tell nothing, and how many pairs meet at a
key grows faster than the texts.  So entries that fit no other one of their key go where
all of them are at hand, and pairs are compared by signatures of two to four bits a shingle
before any set is made: only sets of pairs that are nearly similar are shuffled.

A node is a text's digest (of its words), so exact copies are one node from the start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from repolytics.llm.common import LOWER, Tables, checkpointed, heavy_join, release_memory, sized_partitions
from repolytics.llm.substring import Powers, rolling

MOST_SAMPLED = 20_000
MOST_COMMON = 1_000_000
BLOCK_KEYS = 400_000
SLOTS = 1 << 26


_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(raw: bytes, powers: Powers, block: int = 1 << 20) -> np.ndarray:
    """64-bit polynomial hashes of the words of a UTF-8 text, in blocks of bounded size."""
    out, at = [], 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + block) if len(raw) - at > block else None
        part = np.frombuffer(raw, np.uint8, (cut.start() if cut else len(raw)) - at, at)
        at += len(part)
        inside = np.r_[False, _INSIDE[part], False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        up, down = powers.to(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=sums[1:])
        own = (sums[ends] - sums[starts]) * down[starts]
        own ^= own >> np.uint64(29)
        own *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(own ^ own >> np.uint64(32))
        if not len(part):
            break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Shingles:
    """Sets of word shingles as sorted hashes, and digests of all words, A-Z in lower case."""

    def __init__(self, width: int):
        self.width, self._powers = width, Powers()

    def words(self, text: str | None) -> np.ndarray:
        return word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER), self._powers)

    def digest(self, words: np.ndarray) -> int:
        """A signed 64-bit digest of a sequence of word hashes."""
        up, _ = self._powers.to(len(words) + 1)
        mixed = (int(np.sum(words * up[: len(words)], dtype=np.uint64)) ^ len(words) * 0x9E3779B97F4A7C15) & (2**64 - 1)
        mixed = (mixed ^ mixed >> 31) * 0xD6E8FEB86659FD93 & (2**64 - 1)
        return (mixed ^ mixed >> 32) - (1 << 63)

    def set_of(self, words: np.ndarray) -> np.ndarray:
        if len(words) < self.width:  # a shorter text is one shingle
            return rolling(np.r_[words, np.full(self.width - len(words), 1, np.uint64)], self.width, self._powers)
        return np.unique(rolling(words, self.width, self._powers))

    def __call__(self, text: str | None) -> np.ndarray:
        return self.set_of(self.words(text))


MARKS = ("mark0", "mark1", "mark2", "mark3")


def signature(grams: np.ndarray) -> np.ndarray:
    """256 bits as signed longs: each tells whether an odd number of shingles falls to it.

    Two sets differ in at least as many shingles as their signatures differ in bits.
    """
    odd = np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signature_bits(n: np.ndarray) -> np.ndarray:
    """How long the signature of a set of n is: a power of two, at least 256 and at most 2^17."""
    return np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 8, 17))


def signatures(grams: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each set a bit for every run of hashes: whether an odd number of shingles falls to it."""
    bits, starts, out = signature_bits(sizes), np.cumsum(sizes) - sizes, [b""] * len(sizes)
    for width in np.unique(bits).tolist():
        own = np.flatnonzero(bits == width)
        for at in range(0, len(own), max(1, (1 << 21) // width)):
            part = own[at : at + max(1, (1 << 21) // width)]
            n = sizes[part]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[part], n)
            index = (grams[place] >> np.uint64(65 - int(width).bit_length())).astype(np.int64) + np.repeat(np.arange(len(part)), n) * width
            odd = np.bincount(index, minlength=width * len(part)) & 1
            for i, row in zip(part.tolist(), np.packbits(odd.astype(np.uint8).reshape(-1, width), axis=1)):
                out[i] = row.tobytes()
    return out


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Signature bits at a smaller power of two: a run's bit is that of its parts together."""
    return np.bitwise_xor.reduce(bits.reshape(width, -1), axis=1)


def front(n: int, least: float) -> int:
    """How many shingles of a set of n lead it: one of them is in any set of this similarity."""
    return n - int(np.ceil(least * n - 1e-9)) + 1


_DEALT = "bucket int, rows binary"
_ROW = np.dtype([("key", "<u8"), ("node", "<i8"), ("place", "<i4"), ("n", "<i4"), ("state", "u1")])
ALONE, SHARED, KNOWN = range(3)  # a block's only text of a key, the first of several, the others


def _packed(rows: np.ndarray) -> bytes:
    """Rows byte plane by byte plane, so that a codec shortens what sorted keys have in common."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(-1, _ROW.itemsize).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(_ROW.itemsize, -1).T).reshape(-1).view(_ROW)


def _buckets_of(rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's rows, sorted by key, as one row for each bucket; those known to be shared need not meet any, so each block turns them elsewhere."""
    for known in (False, True):
        part = rows[(rows["state"] == KNOWN) == known]
        if not len(part):
            continue
        bucket = ((part["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
        turn = xxhash.xxh64_intdigest(part[:64].tobytes()) % buckets if known else 0
        out = [((int(bucket[a]) + turn) % buckets, _packed(part[a:b])) for a, b in zip(cuts, [*cuts[1:], len(part)])]
        for at in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 64]), (pa.int32(), pa.binary()))], ["bucket", "rows"])


def _blocks(least: float, width: int, buckets: int, shared):
    """Blocks of texts, each text once a block, whose leading shingles are dealt to buckets."""

    def run(batches):
        (common, counts), shingles = shared.value, Shingles(width)
        held, seen, size = [], set(), 0

        def flush():
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["key"], kind="stable")]
            same = np.r_[False, rows["key"][1:] == rows["key"][:-1]]
            rows["state"] = np.where(same, KNOWN, np.where(np.r_[same[1:], False], SHARED, ALONE))
            yield from _buckets_of(rows, buckets)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for text in batch.column(0).slice(at, 128).to_pylist():
                    words = shingles.words(text)
                    node = shingles.digest(words)
                    if node in seen:
                        continue
                    seen.add(node)
                    every = shingles.set_of(words)
                    near = np.minimum(np.searchsorted(common, every), len(common) - 1)
                    rank = np.where(common[near] == every, counts[near], 0)
                    keys = every[np.lexsort((every, rank))[: front(len(every), least)]]
                    own = np.zeros(len(keys), _ROW)
                    own["key"], own["node"], own["place"], own["n"] = keys, node, np.arange(len(keys)), len(every)
                    held.append(own)
                    size += len(own)
                    if size >= BLOCK_KEYS:
                        yield from flush()
                        held, seen, size = [], set(), 0
        if held:
            yield from flush()
        del held, common, counts
        release_memory()

    return run


def fitting(rows: np.ndarray, least: float) -> np.ndarray:
    """Which rows, sorted by key, may be similar to another one of their key.

    Where other blocks know more rows of a key, all; of two rows, both or none; of more,
    those with one of a similar size.
    """
    if not len(rows):
        return np.zeros(0, bool)
    order = np.lexsort((rows["n"], rows["key"]))
    rows = rows[order]
    n, after = rows["n"].astype(np.int64), rows["n"].astype(np.int64) - rows["place"]
    starts = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]])
    many = np.diff(np.r_[starts, len(rows)])
    same = np.repeat(starts, many)[1:] == np.repeat(starts, many)[:-1]
    size = same & (n[:-1] >= least * n[1:] - 1e-6)
    pair = same & ((1 + least) * np.minimum(after[:-1], after[1:]) >= least * (n[:-1] + n[1:]) - 1e-6)
    next_to = np.where(np.repeat(many, many)[1:] == 2, pair, size)
    kept = np.r_[next_to, False] | np.r_[False, next_to] | np.repeat(np.maximum.reduceat(rows["state"] == SHARED, starts), many)
    out = np.zeros(len(rows), bool)
    out[order] = kept
    return out


def _meet(least: float):
    """Of a bucket, the rows whose key several different texts have that may be similar."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.concatenate([_unpacked(x) for x in table.column("rows").to_pylist()])
        known, rows = rows[rows["state"] == KNOWN], rows[rows["state"] != KNOWN]
        rows = rows[np.lexsort((-rows["state"].astype(np.int8), rows["node"], rows["key"]))]
        rows = rows[np.r_[True, (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])]] if len(rows) else rows
        rows = np.concatenate([known, rows[fitting(rows, least)]])
        return pa.table({"key": pa.array(rows["key"].view(np.int64)), "node": pa.array(rows["node"]), "place": pa.array(rows["place"]), "n": pa.array(rows["n"])})

    return run


def _counted(width: int, buckets: int):
    """Blocks of texts as sorted shingles with the number of texts that hold them, dealt to buckets."""

    def run(batches):
        shingles, held, size = Shingles(width), [], 0

        def flush():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
            spans = list(zip(cuts, [*cuts[1:], len(grams)]))
            columns = ([int(bucket[a]) for a, _ in spans], [grams[a:b].tobytes() for a, b in spans], [n[a:b].astype(np.int32).tobytes() for a, b in spans])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "grams", "counts"])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for text in batch.column(0).slice(at, 128).to_pylist():
                    held.append(shingles(text))
                    size += len(held[-1])
                    if size >= 2 * BLOCK_KEYS:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()
        release_memory()

    return run


def _tally(table: pa.Table) -> pa.Table:
    """Of a bucket, the shingles that several texts have, and how many."""
    grams = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()])
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    sums = np.add.reduceat(n.astype(np.int64), starts)
    return pa.table({"gram": pa.array(grams[starts][sums > 1].view(np.int64)), "n": pa.array(sums[sums > 1])})


def common_shingles(docs: DataFrame, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that a sample of the texts holds twice or more, and how often.

    At most about MOST_SAMPLED texts by a hash of the doc_id, and of their shingles the
    MOST_COMMON commonest, so what reaches the driver is bounded.
    """
    part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-rows // MOST_SAMPLED)))) == 0).select("text")
    counts = checkpointed(part.mapInArrow(_counted(width, 64), "bucket int, grams binary, counts binary").groupBy("bucket").applyInArrow(_tally, "gram long, n long"))
    at_least, left = 2, MOST_COMMON
    for row in sorted(counts.groupBy("n").count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            at_least = row["n"] + 1
            break
    found = counts.filter(F.col("n") >= at_least).toArrow()
    grams, n = (found.column(c).to_numpy() for c in ("gram", "n"))
    order = np.argsort(grams.view(np.uint64))
    return np.r_[grams.view(np.uint64)[order], np.uint64(2**64 - 1)], np.r_[n[order], 0].astype(np.int32)


def shared_keys(docs: DataFrame, rows: int, least: float, width: int, bucket_bytes: int = 1 << 20) -> DataFrame:
    """key, node, place, n: the leading shingles of texts (doc_id, text) that other texts of a size that fits lead with too."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, rows, width))
    buckets = sized_partitions(docs, bucket_bytes, least=64, most=1 << 22)
    dealt = docs.select("text").mapInArrow(_blocks(least, width, buckets, shared), _DEALT)
    return dealt.groupBy("bucket").applyInArrow(_meet(least), "key long, node long, place int, n int").distinct()


def slots_of(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of SLOTS bits (8 MB, whatever the table) of the hashed values of a column."""
    slot = F.pmod(F.xxhash64(column), F.lit(SLOTS))
    found = ids.select(slot.alias("slot")).selectExpr("cast(slot div 64 as int) as word", "shiftleft(1L, cast(slot % 64 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _sets(width: int, bitmap):
    def run(batches):
        bits, shingles = bitmap.value, Shingles(width)
        for batch in batches:
            slot = batch.column(1).to_numpy()
            picked = np.flatnonzero(bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))
            for at in range(0, len(picked), 64):
                words = [shingles.words(t) for t in batch.column(0).take(pa.array(picked[at : at + 64])).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([shingles.digest(w) for w in words], pa.int64()), pa.array([shingles.set_of(w).tobytes() for w in words], pa.binary())], ["node", "grams"])

    return run


def _near(least: float):
    """Pairs whose signatures differ in no more bits than similar sets may in shingles."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, *signs in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                x, y = (np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8)) for v in signs)
                width = min(len(x), len(y))
                differ = int((folded(x, width) ^ folded(y, width)).sum())
                keep.append((1 + least) * differ <= (1 - least) * n + 1e-6)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_pairs(links: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The links (a, b) of nodes whose signatures allow this similarity; reps: node, n, signature."""
    a, b = (reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"sign_{x}")) for x in "ab")
    both = links.join(a, "a").join(b, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "sign_a", "sign_b")
    return both.mapInArrow(_near(least), "a long, b long")


def _similar(least: float):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(docs: DataFrame, links: DataFrame, reps: DataFrame, least: float, width: int) -> DataFrame:
    """The links (a, b) of nodes whose texts have at least this Jaccard similarity of shingle sets.

    docs: doc_id, text.  reps: node, rep (the doc_id of a text of the node), n, signature.
    A bitmap of bounded size tells which documents are needed at all, so only their sets are
    made and, alike on both sides of the join, shuffled once.
    """
    links = checkpointed(near_pairs(links, reps, least))
    ends = checkpointed(links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().join(reps.select("node", "rep"), "node"))
    bitmap = docs.sparkSession.sparkContext.broadcast(slots_of(ends, "rep"))
    sets = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")).mapInArrow(_sets(width, bitmap), "node long, grams binary")
    sets = sets.join(ends, "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams"))
    a, b = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    return links.join(a, "a").join(b, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(_similar(least), "a long, b long")


def linked(docs: DataFrame, proposed: DataFrame, reps: DataFrame, rows: int, least: float, width: int, components) -> DataFrame:
    """node, component of all nodes that some other one is similar to.

    docs: doc_id, text.  proposed: pairs (a, b) of nodes that fingerprints suggest.  reps:
    node, rep and n, the marks and the signature of its set.  components: from edges (a, b)
    to (node, component), cut off from their lineage.
    """
    tables = Tables(docs.sparkSession, "similarity")
    met = tables.put(shared_keys(docs, rows, least, width), "met")

    def fits(x: str, y: str) -> Column:
        """Whether sets that first share a shingle at these places can be similar enough."""
        after = F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place"))
        return (1 + least) * after >= least * (F.col(f"{x}.n") + F.col(f"{y}.n")) - 1e-6

    middle = tables.put(met.groupBy("key").agg(F.min(F.struct("place", "node", "n")).alias("m"), F.count(F.lit(1)).alias("rows")), "middle")
    star = heavy_join(met, middle, "key", "rows", "m").alias("a").filter((F.col("node") != F.col("m.node")) & fits("a", "m"))
    star = star.select(F.least("a.node", "m.node").alias("a"), F.greatest("a.node", "m.node").alias("b"))
    links = tables.put(star.union(proposed).distinct(), "links")
    tables.drop("middle")
    found = components(verified(docs, links, reps, least, width))
    placed = met.join(found, "node", "left").select("key", "node", "place", "n", F.coalesce("component", "node").alias("member"))
    apart = placed.groupBy("key").agg(F.min("member").alias("low"), F.max("member").alias("high")).filter("low < high").select("key")
    placed = tables.put(placed.join(apart, "key", "left_semi").join(reps.select("node", *MARKS), "node"), "placed")
    tables.drop("met")
    a, b = placed.alias("a"), placed.alias("b")
    differ = sum((F.bit_count(F.col(f"a.{m}").bitwiseXOR(F.col(f"b.{m}"))) for m in MARKS[1:]), F.bit_count(F.col("a.mark0").bitwiseXOR(F.col("b.mark0"))))
    near = (1 + least) * differ <= (1 - least) * (F.col("a.n") + F.col("b.n")) + 1e-6
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.member") < F.col("b.member")) & fits("a", "b") & near)
    links = tables.put(pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct(), "links")
    tables.drop("placed")
    more = verified(docs, links, reps, least, width)
    result = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    tables.done()
    return result
