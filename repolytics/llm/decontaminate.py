"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised words inside a sentence) and
units after a number turn into typed placeholders, everything else its lower-case
letters and digits.  Windows of template tokens of the benchmark are hash-joined with
the windows of all documents, so a question whose numbers or names were swapped still
matches.  For each document and item the slots of the matched windows must be
consistent: a value of the item stands for one value in the document throughout.
Windows that contradict the most frequent reading are dropped, and what the rest covers
of the item decides.

A template needs some literal words, or it would match any list of numbers.  Where an
item is so dense in numbers and names that a window of the usual width has too few, wider
windows (each width half as wide again as the last) take in more of the item until they
have enough; what is still uncovered then is matched by the widest windows at both ends
of the item, if the item has two literal words at all.  So re-parameterised arithmetic is
found as well.  Beside that, windows with too few literals and whole items shorter than a
window are matched by their real words, so that no item goes unsearched.

Window hashes of a bounded block of benchmark items are broadcast to keep windows that
cannot match out of the join; a larger benchmark is taken in several blocks.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from repolytics.llm.common import checkpointed, worker_object
from repolytics.llm.substring import Powers, rolling

WINDOW = 8
LEAST_LITERALS = 4
LEAST_LITERALS_OF_ITEM = 2
LEAST_COVERAGE = 0.5
BLOCK_WINDOWS = 2_000_000
# Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur mph kmh kph "
    "degree degrees celsius fahrenheit kelvin hz khz mhz ghz w kw kwh v volt volts watt watts joule joules newton newtons pa kpa bar".split()
)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"^[-+]?[\d][\d.,:/]*(?:st|nd|rd|th)?$")
_LITERAL, _NUM, _NAME, _UNIT = range(4)


class Canonical:
    """Classifies words; keeps what it knows of recent words in bounded memory."""

    def __init__(self, most: int = 250_000):
        self.most = most
        self.mark = [np.uint64(xxhash.xxh64_intdigest(f"<{k}>")) for k in ("", "num", "name", "unit")]
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.hashes, self.flags = np.zeros(4096, np.uint64), np.zeros(4096, np.uint8)

    def _add(self, word: str) -> int:
        at = self.index[word] = len(self.index)
        if at == len(self.hashes):
            self.hashes, self.flags = np.concatenate([self.hashes] * 2), np.concatenate([self.flags] * 2)
        core = _EDGES.sub("", word)
        low = core.lower()
        flag = 0 if core else 1
        flag |= 2 if _NUMBER.match(core) else 0
        flag |= 4 if len(core) > 1 and core[0].isupper() and not core.isupper() else 0
        flag |= 8 if low in UNITS else 0
        flag |= 16 if word.rstrip("\"')]}»”’").endswith((".", "!", "?", ":", "…")) else 0
        self.hashes[at], self.flags[at] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")), flag
        return at

    def tokens(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, place of each token among them, kinds, hashes, hashes of the real words); words without letters or digits give no token."""
        words = (text or "").split()
        if len(self.index) > self.most:
            self._reset()
        get = self.index.get
        at = [get(w) for w in words]
        if None in at:
            at = [self._add(w) if (i := get(w)) is None else i for w in words]
        at = np.array(at, np.int64)
        flags = self.flags[at]
        ends = np.r_[True, (flags[:-1] & 16) > 0] if len(flags) else np.zeros(0, bool)
        real = np.flatnonzero((flags & 1) == 0)
        flags, hashes, ends = flags[real], self.hashes[at[real]], ends[real]
        kinds = np.zeros(len(real), np.uint8)
        kinds[((flags & 4) > 0) & ~ends] = _NAME
        number = (flags & 2) > 0
        kinds[number] = _NUM
        kinds[np.r_[False, number[:-1]] & ((flags & 8) > 0) if len(real) else []] = _UNIT
        real_hashes = hashes
        for kind in (_NUM, _NAME, _UNIT):
            hashes = np.where(kinds == kind, self.mark[kind], hashes)
        return words, real, kinds, hashes, real_hashes


def _real(hashes: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hashes of the windows of real words, apart from those of templates and other widths."""
    return rolling(hashes, width, powers) ^ np.uint64(0x9E3779B97F4A7C15 * (width + 1) & (2**64 - 1))


def item_windows(kinds: np.ndarray, width: int, least_literals: int) -> list[tuple[int, int, bool]]:
    """(start, width, real words?) of the windows by which an item is searched."""
    n = len(kinds)
    if n < width:
        return [(0, n, True)] if n else []
    literals, covered, out, widest = np.r_[0, np.cumsum(kinds == _LITERAL)], np.zeros(n, bool), [], width
    own = width
    while own <= n:
        bare = np.r_[0, np.cumsum(~covered)]
        starts = np.flatnonzero((literals[own:] - literals[:-own] >= least_literals) & (bare[own:] - bare[:-own] > 0))
        out += [(s, own, False) for s in starts.tolist()]
        for s in starts:
            covered[s : s + own] = True
        widest, own = own, own + own // 2
    if not covered.all() and literals[-1] >= LEAST_LITERALS_OF_ITEM:
        out += [(s, widest, False) for s in sorted({0, n - widest}) if literals[s + widest] > literals[s]]
    few = np.flatnonzero(literals[width:] - literals[:-width] < least_literals)
    return sorted(set(out)) + [(s, width, True) for s in few.tolist()]


_WINDOWS = "id long, text_key long, hash long, n long, starts array<int>, place int, last int, tokens int, slots array<string>, width int, real boolean"


def _emit(width: int, least_literals: int, wanted=None, key: str = ""):
    """Windows of items (without wanted), or those of documents that some item has.

    Windows of a text with one hash and equal slots are one row: how many, where each
    starts, the first and the last word.
    """

    def run(batches):
        canonical, powers = worker_object(key + "canonical", lambda: (Canonical(), Powers()))
        only, kinds_of = wanted.value if wanted is not None else (None, None)
        rows: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words, places, kinds, hashes, real = canonical.tokens(text)
                    found: dict[tuple, list] = {}
                    own = item_windows(kinds, width, least_literals) if only is None else None
                    for wide, as_real in sorted({(w, r) for _, w, r in own}) if own is not None else kinds_of:
                        if len(places) < wide:
                            continue
                        rolled = _real(real, wide, powers) if as_real else rolling(hashes, wide, powers)
                        if own is not None:
                            starts = np.array([s for s, w, r in own if (w, r) == (wide, as_real)])
                        else:
                            near = np.minimum(np.searchsorted(only, rolled), len(only) - 1)
                            starts = np.flatnonzero(only[near] == rolled)
                        for s, h in zip(starts.tolist(), rolled[starts].view(np.int64).tolist()):
                            slots = () if as_real else tuple(f"{kinds[i]}{_EDGES.sub('', words[places[i]]).lower()}" for i in range(s, s + wide) if kinds[i])
                            found.setdefault((h, wide, as_real, slots), []).append(s)
                    text_key = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)
                    for (h, wide, as_real, slots), starts in found.items():
                        rows.append((doc, text_key, h, len(starts), starts if only is None else None, int(places[starts[0]]), int(places[starts[-1] + wide - 1]), len(places), slots, wide, as_real))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in _WINDOWS.split(", ")])


_FOUND = "doc_id long, item_id long, n_windows long, n_inconsistent long, coverage double, first_word long, last_word long"


def _judge(table: pa.Table) -> pa.Table:
    """The verdict on one text and one item: what consistently matched windows cover of the item."""
    rows = table.to_pylist()
    votes: dict[str, Counter] = {}
    for r in rows:
        for a, b in zip(r["item_slots"], r["doc_slots"]):
            votes.setdefault(a, Counter())[b] += r["n"] * len(r["item_starts"])
    reading = {a: min(c, key=lambda b: (-c[b], b)) for a, c in votes.items()}
    good = [r for r in rows if all(reading[a] == b for a, b in zip(r["item_slots"], r["doc_slots"]))]
    held = {(s, r["width"], r["real"]) for r in good for s in r["item_starts"]}
    every = {(s, r["width"], r["real"]) for r in rows for s in r["item_starts"]}
    covered = {p for s, w, _ in held for p in range(s, s + w)}
    out = (rows[0]["doc_id"], rows[0]["item_id"], len(held), len(every - held), len(covered) / rows[0]["item_tokens"], min((r["place"] for r in good), default=None), max((r["last"] for r in good), default=None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    return pa.table({f.split()[0]: pa.array([v], k) for f, k, v in zip(_FOUND.split(", "), kinds, out)})


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, least_literals: int = LEAST_LITERALS, least_coverage: float = LEAST_COVERAGE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, n_inconsistent, coverage, first_word, last_word of each leak.

    A document leaks an item when consistently matched windows cover least_coverage of the
    item's tokens; n_windows counts the item's windows that matched, n_inconsistent those
    that matched only against the reading.  The reading of a slot is its most frequent
    value, of equally frequent ones the smallest.  Null and empty texts match nothing; rows
    that repeat a doc_id or item_id are judged each by its own text, and the best coverage
    stands for the pair (ties: the most windows, then the first place); rows without an id
    are left out; empty tables give an empty result; further columns are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    key = uuid.uuid4().hex
    wanted = checkpointed(items.mapInArrow(_emit(width, least_literals, key=key), _WINDOWS))
    kinds = sorted((r["width"], r["real"]) for r in wanted.select("width", "real").distinct().collect())
    blocks = max(1, -(-wanted.count() // block_windows))
    out = None
    for block in range(blocks):
        part = wanted.filter(F.pmod(F.col("hash"), F.lit(blocks)) == block)
        hashes = np.unique(part.select("hash").distinct().toArrow().column("hash").to_numpy().view(np.uint64))
        if not len(hashes):
            hashes = np.zeros(1, np.uint64)
        shared = spark.sparkContext.broadcast((hashes, kinds))
        found = texts.mapInArrow(_emit(width, least_literals, shared, key), _WINDOWS)
        out = found if out is None else out.unionByName(found)
    left = out.select(F.col("id").alias("doc_id"), F.col("text_key").alias("doc_key"), "hash", "n", "place", "last", F.col("slots").alias("doc_slots"))
    right = wanted.select(F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), F.col("hash").alias("item_hash"), F.col("starts").alias("item_starts"), F.col("tokens").alias("item_tokens"), F.col("slots").alias("item_slots"), "width", "real")
    pairs = left.join(right, left["hash"] == right["item_hash"]).drop("hash", "item_hash")
    found = pairs.groupBy("doc_id", "doc_key", "item_id", "item_key").applyInArrow(_judge, _FOUND)
    best = F.struct("coverage", "n_windows", -F.col("first_word"))
    row = F.struct("n_windows", "n_inconsistent", "coverage", "first_word", "last_word")
    return found.filter(F.col("coverage") >= least_coverage).groupBy("doc_id", "item_id").agg(F.max_by(row, best).alias("r")).select("doc_id", "item_id", "r.*")
