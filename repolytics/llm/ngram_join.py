"""Components of documents whose sets of word shingles have a given Jaccard similarity.

A size-aware heavy-light join.  All shingles stand in one fixed order, rare ones first (a
sample tells which are common; any order gives the same links).  With o the least overlap a
set of n shingles can have with a similar one, the first k shingles that two similar sets
share are among the first n - o + k of both.

* Light sets, small ones, enumerate all subsets of two of these (k = 2) as join keys.  Few
  unlike sets share one.
* Heavy sets would have too many, so they scan inverted lists: their keys are the first
  n - o + 1 shingles alone (k = 1).  Light sets that a heavy one can be similar to stand in
  these lists as well.
* The boundary is the largest size at which the subsets of a set cost no more than its
  lists, whose length is measured on the sample and carried on to all documents.

Keys of a block of documents are sorted and dealt to buckets by their leading bits; a key
that many documents of a block hold goes to its bucket once, the rest are known to be shared
and go to any.  Each list is first compared with one of its sets, the one that comes first
in an order all lists share, so a group of near copies costs a few comparisons a member;
what is still in different components is compared with the first in another order, a few
times.  Only members that then are apart meet pair by pair, inside Spark's join, by size,
place and 256 bits of parity; the members of a long list first go on to the lists of two
shingles, of which that list's is the first.

Pairs whose longer signatures (a bit or two a shingle) differ too much are dropped, every
other one is verified on the full sets.  A node of the graph is a set, so documents of equal
sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from repolytics.llm.common import LOWER, batches_of, checkpointed, heavy_join, new_folder, release_memory, removed_folder, shuffles_removed, sized_partitions
from repolytics.llm.importance import blocks, word_spans
from repolytics.llm.similarity import _BYTES, _INSIDE, MARKS, MOST_SAMPLED, SLOTS, common_shingles, folded, signature_bits, signatures, slots_of
from repolytics.llm.simhash import components
from repolytics.llm.substring import Powers, rolling

WIDTH = 5
PERCENT = 80
BLOCK_KEYS = 400_000
BATCH_ROWS = 1_000
STARS = 2  # orders in which lists are compared with their first set
MOST_SENT = 200_000  # nodes whose hashes are broadcast to find their documents; more go by a bitmap
BANDS = 4  # to which sizes of a list are cut where they double
COMPARED = 0.1  # what a comparison within a list costs, where dealing a key costs 1
LONG_LIST = 2_000  # sets of a list that are compared pair by pair; longer ones are cut by a second shingle
DEAR_LIST = 64  # what a longer list counts as where the boundary is chosen: most of its sets are linked without comparing all
_LOWER = np.frombuffer(LOWER, np.uint8)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def least_overlap(n, percent: int):
    """The fewest shingles that a set of n shares with any similar one."""
    return -(-percent * n // 100)


def front(n, percent: int, k: int):
    """How many leading shingles of a set hold the first k that it shares with a similar one."""
    return n - least_overlap(n, percent) + k


def linkable(n, percent: int):
    """Whether a set of n can be similar to a set that is not equal to it."""
    return (100 * n // percent > n) | (least_overlap(n, percent) < n)


def boundary(list_length: float, percent: int = PERCENT, most: int = 1 << 16) -> int:
    """The largest size at which the subsets of two cost no more than the lists of single shingles.

    A set costs a row for each key and, in a list, a comparison for each other set of it;
    list_length is how many of these a key has on average, at most DEAR_LIST of any list.
    """
    n = np.arange(most + 1)
    two, one = front(n, percent, 2), front(n, percent, 1)
    dear = np.flatnonzero(two * (two - 1) / 2 > one * (1 + COMPARED * list_length))
    return int(dear[0]) - 1 if len(dear) else most


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX
    return x ^ x >> np.uint64(31)


_PAIR = np.uint64(1)  # the lowest bit of a key tells whether it is of two shingles


def single_keys(grams: np.ndarray) -> np.ndarray:
    return grams & ~_PAIR


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A key for two shingles in their order."""
    return _mixed(first * np.uint64(0x9E3779B97F4A7C15) + _mixed(second)) | _PAIR


class Sets:
    """Sets of word shingles as sorted hashes, a block of texts at a time."""

    def __init__(self, width: int):
        self.width, self._powers = width, Powers()

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = _LOWER[data]
        starts, ends = word_spans(data, offsets[:-1], _INSIDE)
        up, down = self._powers.to(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
        words = (sums[ends] - sums[starts]) * down[starts]
        words ^= words >> np.uint64(29)
        words *= _MIX
        return words ^ words >> np.uint64(32), np.diff(np.searchsorted(starts, offsets))

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of all texts, each text's sorted and once, and how many each has.

        A text of fewer words than the width is one shingle, one without words none.
        """
        words, n_words = self._words(data, offsets)
        first = np.r_[0, np.cumsum(n_words)]
        every = rolling(words, self.width, self._powers)
        parts, sizes = [], np.zeros(len(n_words), np.int64)
        for i in np.flatnonzero(n_words):
            a, b = first[i], first[i + 1]
            if b - a < self.width:
                own = rolling(np.r_[words[a:b], np.full(self.width - (b - a), 1, np.uint64)], self.width, self._powers)
            else:
                own = every[a : b - self.width + 1]
                own.sort()
                again = own[1:] == own[:-1]
                if again.any():
                    own = own[np.r_[True, ~again]]
            parts.append(own)
            sizes[i] = len(own)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for at, to, data, offsets in blocks(texts):
            yield at, to, *self.block(data, offsets)


def nodes_of(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit digest of every set; -1 of the empty one."""
    out = np.full(len(sizes), -1, np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        sums = np.add.reduceat(_mixed(grams), (np.cumsum(sizes) - sizes)[some])
        out[some] = _mixed(sums ^ sizes[some].astype(np.uint64)).view(np.int64)
    return out


def marks_of(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(n, 4) signed longs: 256 bits that tell whether an odd number of shingles falls to each.

    Two sets differ in at least as many shingles as their marks differ in bits.
    """
    of = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(of * 256 + (grams >> np.uint64(56)).astype(np.int64), minlength=256 * len(sizes)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 256), axis=1).view(np.int64)


def in_order(grams: np.ndarray, sizes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each set with rare ones first, and how often the sample holds each."""
    near = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    rank = np.where(common[near] == grams, counts[near], 0)
    order = np.lexsort((rank, np.repeat(np.arange(len(sizes)), sizes)))
    return grams[order], rank[order]


_ROW = np.dtype([("key", "<u8"), ("node", "<i8"), ("place", "<i4"), ("n", "<i4"), ("state", "u1")])
_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("node", "<i8"), ("n", "<i4"), ("marks", "<i8", (4,))])
ALONE, SHARED, KNOWN = range(3)  # a block's only set of a key, the first of several, the others


def keys_of(grams: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, percent: int, most_light: int) -> np.ndarray:
    """The keys (as _ROW) of linkable sets whose shingles are in order.

    place is such that no similar pair that first meets at a key shares more than n - place.
    """
    starts, out = np.cumsum(sizes) - sizes, []

    def add(key, own, place):
        rows = np.zeros(len(key), _ROW)
        rows["key"], rows["node"], rows["place"], rows["n"] = key, nodes[own], place, sizes[own]
        out.append(rows)

    listed = np.flatnonzero(100 * sizes > percent * most_light)
    long = front(sizes[listed], percent, 1)
    own = np.repeat(listed, long)
    place = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
    add(single_keys(grams[starts[own] + place]), own, place)
    light = np.flatnonzero(sizes <= most_light)
    two = front(sizes[light], percent, 2)
    for p in np.unique(two).tolist():
        own = light[two == p]
        leading = grams[starts[own][:, None] + np.arange(p)]
        i, j = np.triu_indices(p, 1)
        add(pair_keys(leading[:, i], leading[:, j]).ravel(), np.repeat(own, len(i)), np.tile(j - 1, len(own)))
    return np.concatenate(out)


def _planes(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows.view(np.uint8).reshape(-1, rows.dtype.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


_DEALT = "bucket int, rows binary, docs binary, signs binary"


def _deal(percent: int, width: int, buckets: int, most_light: int, shared):
    """Texts to sorted runs of keys, a row for each block and bucket, and their documents."""

    def run(batches):
        (common, counts), sets = shared.value, Sets(width)
        held, docs, signs, seen, size = [], [], [], set(), 0

        def rows_out(found):
            for at in range(0, len(found), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[at : at + 64]), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "rows", "docs", "signs"])

        def flush():
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["key"], kind="stable")]
            same = np.r_[False, rows["key"][1:] == rows["key"][:-1]]
            rows["state"] = np.where(same, KNOWN, np.where(np.r_[same[1:], False], SHARED, ALONE))
            for known in (False, True):
                part = rows[(rows["state"] == KNOWN) == known]
                if not len(part):
                    continue
                bucket = ((part["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
                turn = xxhash.xxh64_intdigest(part[:64].tobytes()) % buckets if known else 0  # known ones need not meet any
                yield from rows_out([((int(bucket[a]) + turn) % buckets, _planes(part[a:b]), None, None) for a, b in zip(cuts, [*cuts[1:], len(part)])])

        def flush_docs():
            own = np.concatenate(docs)
            yield from rows_out([(xxhash.xxh64_intdigest(own[a : a + 1].tobytes()) % buckets, None, _planes(own[a : a + 256]), b"".join(signs[a : a + 256])) for a in range(0, len(own), 256)])

        for batch in batches:
            ids = batch.column(0)
            known, ids = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy()
            for at, to, grams, sizes in sets.blocks(batch.column(1)):
                nodes, own = nodes_of(grams, sizes), np.zeros(to - at, _DOC)
                own["doc_id"], own["known"], own["node"], own["n"], own["marks"] = ids[at:to], known[at:to], nodes, sizes, marks_of(grams, sizes)
                docs.append(own)
                signs += signatures(grams, sizes)
                fresh = np.zeros(to - at, bool)
                for i, node in enumerate(nodes.tolist()):
                    if node not in seen:
                        seen.add(node)
                        fresh[i] = True
                fresh &= linkable(sizes, percent)
                ordered, _ = in_order(grams[np.repeat(fresh, sizes)], sizes[fresh], common, counts)
                held.append(keys_of(ordered, sizes[fresh], nodes[fresh], percent, most_light))
                size += len(held[-1])
                if size >= BLOCK_KEYS:
                    yield from flush()
                    held, seen, size = [], set(), 0
                if len(signs) >= 2048:
                    yield from flush_docs()
                    docs, signs = [], []
        if held and size:
            yield from flush()
        if docs:
            yield from flush_docs()
        del held, docs, signs, seen, common, counts
        release_memory()

    return run


_MET = "key long, node long, place int, n int, doc_id long, mark0 long, mark1 long, mark2 long, mark3 long, signature binary, is_doc boolean"


def _meet(table: pa.Table) -> pa.Table:
    """Of a bucket, the keys that several different sets have, and its documents."""
    rows = np.concatenate([np.zeros(0, _ROW), *(_unplanes(x, _ROW) for x in table.column("rows").to_pylist() if x)])
    docs = np.concatenate([np.zeros(0, _DOC), *(_unplanes(x, _DOC) for x in table.column("docs").to_pylist() if x)])
    signs = b"".join(x for x in table.column("signs").to_pylist() if x)
    ends = np.cumsum(signature_bits(docs["n"]) // 8)
    signs = [signs[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist() if len(ends) else [], ends.tolist())]
    known, rows = rows[rows["state"] == KNOWN], rows[rows["state"] != KNOWN]
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    if len(rows):
        first = np.r_[True, rows["key"][1:] != rows["key"][:-1]]
        other = ~first & np.r_[False, rows["node"][1:] != rows["node"][:-1]]
        starts = np.flatnonzero(first)
        several = np.maximum.reduceat(other | (rows["state"] == SHARED), starts)
        rows = rows[np.repeat(several, np.diff(np.r_[starts, len(rows)])) & (first | other)]
    rows = np.concatenate([known, rows])
    none = lambda n, kind: pa.nulls(n, kind)
    met = [pa.array(rows["key"].view(np.int64)), pa.array(rows["node"]), pa.array(rows["place"]), pa.array(rows["n"]), *(none(len(rows), pa.int64()) for _ in range(5)), none(len(rows), pa.binary()), pa.array(np.zeros(len(rows), bool))]
    own = [none(len(docs), pa.int64()), pa.array(docs["node"]), none(len(docs), pa.int32()), pa.array(docs["n"]), pa.array(docs["doc_id"], mask=docs["known"] == 0), *(pa.array(np.ascontiguousarray(docs["marks"][:, i])) for i in range(4)), pa.array(signs, pa.binary()), pa.array(np.ones(len(docs), bool))]
    return pa.table([pa.chunked_array([a, b]) for a, b in zip(met, own)], names=[x.split()[0] for x in _MET.split(", ")])


def _list_lengths(percent: int, width: int, step: int, shared):
    def run(batches):
        (common, counts), sets = shared.value, Sets(width)
        others = keys = 0
        for batch in batches:
            for _, _, grams, sizes in sets.blocks(batch.column(0)):
                _, rank = in_order(grams, sizes, common, counts)
                place = np.arange(len(rank)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                lead = rank[place < np.repeat(front(sizes, percent, 1), sizes)]
                others, keys = others + int(np.clip((lead.astype(np.int64) - 1) * step, 0, DEAR_LIST).sum()), keys + len(lead)
        yield pa.RecordBatch.from_pydict({"others": [others], "keys": [keys]})

    return run


def _sets(width: int, bitmap):
    """node, grams of texts (text, slot); with a bitmap only of those whose slot is set in it."""

    def run(batches):
        sets = Sets(width)
        for batch in batches:
            texts = batch.column(0)
            if bitmap is not None:
                bits, slot = bitmap.value, batch.column(1).to_numpy()
                texts = texts.filter(pa.array((bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for _, _, grams, sizes in sets.blocks(texts):
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(nodes_of(grams, sizes)), pa.array([grams[e - n : e].tobytes() for e, n in zip(ends, sizes)], pa.binary())], ["node", "grams"])
        release_memory()

    return run


def _near(percent: int):
    """Pairs whose signatures differ in no more bits than similar sets may in shingles."""

    def run(batches):
        for batch in batches:
            keep = []
            for n, *signs in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                x, y = (np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8)) for v in signs)
                width = min(len(x), len(y))
                differ = int((folded(x, width) ^ folded(y, width)).sum())
                keep.append((100 + percent) * differ <= (100 - percent) * n)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _extended(percent: int, shared):
    """Sets with the keys of long lists they are in, to keys of two shingles that begin with one of these."""

    def run(batches):
        common, counts = shared.value
        for batch in batches:
            for node, raw, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own, _ = in_order(np.frombuffer(raw, np.uint64), np.array([len(raw) // 8]), common, counts)
                lead = own[: front(len(own), percent, 2)]
                out = [np.zeros(0, _ROW)]
                for place in np.flatnonzero(np.isin(single_keys(lead), np.array(lists, np.int64).view(np.uint64))).tolist():
                    rows = np.zeros(len(lead) - place - 1, _ROW)
                    rows["key"] = pair_keys(np.broadcast_to(lead[place], len(rows)), lead[place + 1 :])
                    rows["node"], rows["place"], rows["n"] = node, np.arange(place, len(lead) - 1), len(own)
                    out.append(rows)
                rows = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(rows["key"].view(np.int64)), pa.array(rows["node"]), pa.array(rows["place"]), pa.array(rows["n"])], ["key", "node", "place", "n"])

    return run


class _Join:
    """The links of one call: what all its steps need, and the tables they leave for the next."""

    def __init__(self, docs: DataFrame, percent: int, width: int, shared):
        self.spark, self.docs, self.percent, self.width, self.shared, self._folders = docs.sparkSession, docs, percent, width, shared, {}

    def put(self, df: DataFrame, slot: str) -> DataFrame:
        """Cut lineage with a table in the shared folder; what the slot held before goes."""
        folder, before = new_folder(self.spark, "ngram-join"), self._folders.get(slot)
        with shuffles_removed(self.spark):
            df.select("*").write.parquet(folder)
        self._folders[slot] = folder
        if before:
            removed_folder(self.spark, before)
        return self.spark.read.parquet(folder)

    def done(self) -> None:
        for folder in self._folders.values():
            removed_folder(self.spark, folder)

    def fits(self, x: str, y: str) -> Column:
        """Whether sets that first meet at these places can share enough."""
        most = F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place"))
        return (100 + self.percent) * most >= self.percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    def near(self, x: str, y: str) -> Column:
        """Whether the marks of sets allow so few differences."""
        differ = sum((F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in MARKS[1:]), F.bit_count(F.col(f"{x}.mark0").bitwiseXOR(F.col(f"{y}.mark0"))))
        return (100 + self.percent) * differ <= (100 - self.percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    def sets(self, nodes: DataFrame, slot: str) -> DataFrame:
        """node, grams of these nodes.

        Their documents are found by a broadcast of hashes where the nodes are few enough,
        else by a bitmap of fixed size.
        """
        ends = checkpointed(nodes.join(self.reps.select("node", "rep"), "node"))
        texts = self.docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot"), F.xxhash64("doc_id").alias("h"))
        if ends.count() <= MOST_SENT:
            bitmap, texts = None, texts.join(F.broadcast(ends.select(F.xxhash64("rep").alias("h")).distinct()), "h", "left_semi")
        else:
            bitmap = self.spark.sparkContext.broadcast(slots_of(ends, "rep"))
        found = texts.select("text", "slot").mapInArrow(_sets(self.width, bitmap), "node long, grams binary")
        return self.put(found.join(ends.select("node"), "node", "left_semi").dropDuplicates(["node"]), slot)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar."""
        x, y = self.reps.alias("x"), self.reps.alias("y")
        by_marks = pairs.distinct().join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(self.near("x", "y")).select("a", "b", (F.col("x.n") + F.col("y.n")).alias("n"))
        a, b = (self.signs.select(F.col("node").alias(e), F.col("signature").alias(f"sign_{e}")) for e in "ab")
        near = by_marks.join(a, "a").join(b, "b").select("a", "b", "n", "sign_a", "sign_b").mapInArrow(_near(self.percent), "a long, b long")
        pairs = checkpointed(near)
        if not pairs.limit(1).count():
            return pairs
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "sets")
        a, b = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
        return checkpointed(pairs.join(a, "a").join(b, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(_similar(self.percent), "a long, b long"))

    def starred(self, placed: DataFrame, turn: int) -> DataFrame:
        """Pairs of sets of a list with the first one of their size in it, where these are apart.

        A list is cut into bands of sizes that can be similar at all, elsewhere in every
        turn.  First is who comes first in an order of components, then of sets, that all
        lists share and every turn has its own of, so a component has a turn sooner or later
        however many sets another one has; sets that fit none of their size come last.
        """
        band = F.floor(F.log2("n") * BANDS + turn / STARS)
        placed = placed.select(F.xxhash64("key", band).alias("band"), "node", "place", "n", "member")
        late = (100 + self.percent) * (F.col("n") - F.col("place")) < 2 * self.percent * F.col("n")  # fits none of its own size
        first = F.min(F.struct(late.alias("late"), F.xxhash64(F.lit(turn), "member").alias("c"), F.xxhash64(F.lit(turn), "node").alias("h"), "node", "place", "n", "member"))
        middle = checkpointed(placed.groupBy("band").agg(first.alias("m"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
        star = heavy_join(placed, middle, "band", "rows", "m").withColumn("a", F.struct("node", "place", "n"))
        star = star.filter((F.col("member") != F.col("m.member")) & self.fits("a", "m"))
        return star.select(F.least("a.node", "m.node").alias("a"), F.greatest("a.node", "m.node").alias("b"))

    def apart(self, placed: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of lists whose sets are in several components, with member, the component."""
        placed = placed.select("key", "node", "place", "n").join(found, "node", "left").select("key", "node", "place", "n", F.coalesce("component", "node").alias("member"))
        several = placed.groupBy("key").agg(F.min("member").alias("low"), F.max("member").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high").select("key", "size")
        return self.put(placed.join(several, "key"), "placed")

    def pairs(self, placed: DataFrame) -> DataFrame:
        """Pairs of different components that a list holds and size, place and marks allow."""
        placed = checkpointed(placed.join(self.reps.select("node", *MARKS), "node"))
        a, b = placed.alias("a"), placed.alias("b")
        both = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.member") < F.col("b.member")) & self.fits("a", "b") & self.near("a", "b"))
        return both.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))

    def further(self, long: DataFrame) -> DataFrame:
        """The lists of two shingles that the sets of long lists go on to."""
        of = long.groupBy("node").agg(F.collect_set("key").alias("lists"))
        own = self.sets(long.select("node").distinct(), "long").join(of, "node").select("node", "grams", "lists")
        return self.put(own.mapInArrow(_extended(self.percent, self.shared), "key long, node long, place int, n int"), "lists")

    def linked(self, lists: DataFrame, found: DataFrame, further: bool) -> DataFrame:
        """node, component over what is found already and the lists (key, node, place, n)."""
        edges = lambda x: x.select(F.col("node").alias("a"), F.col("component").alias("b"))
        placed = self.apart(lists, found)
        for turn in range(STARS):
            links = self.verified(self.starred(placed, turn))
            if not links.limit(1).count():
                break
            found = checkpointed(components(edges(found).union(links)))
            placed = self.apart(placed, found)
        is_long = F.lit(further) & (F.col("size") > LONG_LIST) & (F.col("key").bitwiseAND(1) == 0)
        long = checkpointed(placed.filter(is_long).select("key", "node"))
        found = checkpointed(components(edges(found).union(self.verified(self.pairs(placed.filter(~is_long))))))
        return self.linked(self.further(long), found, False) if long.limit(1).count() else found


def linked_documents(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, bucket_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Documents link when 100 times their common shingles reach percent times those of either;
    component_id is the smallest doc_id reachable.  Texts of fewer words than width are one
    shingle, null texts and texts without words have none and link with nothing, each its
    own component.  Repeated rows link by their texts; rows without a doc_id link like any
    other and keep the null, and a component of such rows alone has a null component_id; an
    empty table gives an empty result; further columns are not looked at.  A very long text
    is held whole, at some twenty bytes a word.
    """
    if not 51 <= percent <= 100:
        raise ValueError("similarities from 51 to 100 percent")
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _linked(docs.select("doc_id", "text"), percent, width, bucket_bytes)


def _linked(docs: DataFrame, percent: int, width: int, bucket_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.count()
    shared = spark.sparkContext.broadcast(common_shingles(docs, rows, width))
    step = max(1, -(-rows // MOST_SAMPLED))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text").distinct()
    measured = sample.mapInArrow(_list_lengths(percent, width, step, shared), "others long, keys long").agg(F.sum("others").alias("others"), F.sum("keys").alias("keys")).first()
    most_light = boundary((measured["others"] or 0) / max(1, measured["keys"] or 0), percent)
    join = _Join(docs, percent, width, shared)
    buckets = sized_partitions(docs, bucket_bytes, least=64, most=1 << 22)
    met = join.put(docs.mapInArrow(_deal(percent, width, buckets, most_light, shared), _DEALT).groupBy("bucket").applyInArrow(_meet, _MET), "met")
    own = met.filter("is_doc").select("doc_id", "node", "n")
    full = met.filter("is_doc and n > 0")
    reps = checkpointed(full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), *(F.first(m).alias(m) for m in MARKS)))
    lists = join.put(met.filter("not is_doc").select("key", "node", "place", "n").distinct(), "lists")
    listed = lists.select("node").distinct()
    join.reps = reps.select("node", "rep", "n", *MARKS)
    join.signs = join.put(full.select("node", "signature").join(listed, "node", "left_semi").dropDuplicates(["node"]), "signs")
    found = join.linked(lists, spark.createDataFrame([], "node long, component long"), True)
    placed = checkpointed(reps.join(found, "node", "left").select(F.col("node").alias("of_node"), "rep", "rows", F.coalesce("component", "node").alias("group")))
    groups = checkpointed(placed.groupBy("group").agg(F.min("rep").alias("component_id"), F.sum("rows").alias("n_rows")))
    placed = checkpointed(heavy_join(placed, groups, "group", "n_rows", "component_id").select("of_node", "rows", F.struct("component_id").alias("of")))
    linked = heavy_join(own.filter("n > 0"), placed, ("node", "of_node"), "rows", "of").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "of.component_id")
    alone = own.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    result = checkpointed(linked.unionByName(alone))
    join.done()
    return result


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END)) AS g FROM d),
k AS (SELECT g, min(rid) AS node, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT node, n, unnest(g) AS f FROM k),
o AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.f = b.f AND a.node < b.node AND 5 * b.n >= 4 * a.n AND 5 * a.n >= 4 * b.n GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
r AS (SELECT a AS node, a AS top FROM e UNION SELECT e.b, r.top FROM r JOIN e ON r.node = e.a),
t AS (SELECT node, min(top) AS top FROM r GROUP BY node),
p AS (SELECT s.rid, doc_id, len(s.g) AS n, CASE WHEN len(s.g) = 0 THEN -s.rid ELSE coalesce(t.top, k.node) END AS top FROM s LEFT JOIN k ON s.g = k.g LEFT JOIN t USING (node))
SELECT doc_id, n::BIGINT AS n_shingles, min(doc_id) OVER (PARTITION BY top) AS component_id FROM p
"""
