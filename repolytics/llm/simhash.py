"""SimHash near-duplicate components by Golay-code fuzzy hashing.

Every document gets a 64-bit fingerprint of its 3-word shingles.  Two fingerprints
link when they differ in at most three bits.  Candidate pairs come from fuzzy keys:

* the fingerprint is cut into four 16-bit segments.  Three wrong bits cannot touch
  all four, so at least one segment agrees exactly (pigeonhole);
* the other 48 bits hold at most three wrong bits; two 23-bit windows of them are
  read as words of the binary Golay code [23, 12, 7], so one of the two windows
  has at most one wrong bit (pigeonhole again);
* a 23-bit word is decoded to every codeword within distance four, which is one or
  six codewords; two words at distance two or less always share one of them.

A key is (segment, exact 16 bits, window, codeword index): at most 48 keys a
fingerprint, and any linked pair shares at least one.  Candidates are then verified
by their Hamming distance, so the links are exact.

Where links are decided by the Jaccard similarity of shingle sets, no fingerprint
radius finds all of them.  The fingerprints then propose the bulk of the links, and an
exact prefix filter (similarity) those that they miss.

Components are computed in Spark by alternating large-star and small-star rounds on
the graph of distinct fingerprints; nothing proportional to the corpus reaches the
driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from repolytics.llm import similarity
from repolytics.llm.common import Tables, checkpointed, heavy_join, words_of

SEED = 42
SHINGLE = 3
MAX_BITS = 3
GOLAY_POLYNOMIAL = 0b101011100011  # fixed value: generator x^11+x^9+x^7+x^6+x^5+x+1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; 0 where it has no words.

    A-Z are lower-cased, words are runs of anything but space and \\x09-\\x0D, shingles
    count as often as they occur.  A bit is set where over half the hashes set it.
    """
    words = words_of(text, lower=True)
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
    return majority(hashes)


def majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The bits set in over half of the hashes, counted in blocks of bounded size."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def _remainders() -> np.ndarray:
    """x^11 * m mod the generator, for every 12-bit message m."""
    m = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        m = np.where(m >> bit & 1, m ^ (GOLAY_POLYNOMIAL << (bit - 11)), m)
    return m


def _patterns(remainders: np.ndarray) -> np.ndarray:
    """For every syndrome, the error words (weight <= 4) that lead to codewords; -1 pads.

    A leader of weight two or less stands alone; one of weight three has five more
    words of weight four in its coset.
    """
    from itertools import combinations

    def syndrome(word: int) -> int:
        return int(remainders[word >> 11]) ^ (word & 0x7FF)

    table = np.full((1 << 11, 6), -1, np.int64)
    used = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            s = syndrome(word)
            table[s, used[s]] = word
            used[s] += 1
    return table


_REMAINDERS = _remainders()
_PATTERNS = _patterns(_REMAINDERS)


def codewords_near(words: np.ndarray) -> np.ndarray:
    """(n, 6) 12-bit indices of the codewords within distance four of 23-bit words; -1 pads."""
    syndromes = _REMAINDERS[words >> 11] ^ (words & 0x7FF)
    errors = _PATTERNS[syndromes]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(prints: np.ndarray) -> np.ndarray:
    """(n, 48) fuzzy keys of unsigned 64-bit fingerprints; -1 where a slot is unused."""
    out = np.full((len(prints), 4, 2, 6), -1, np.int64)
    for segment in range(4):
        low = prints & np.uint64((1 << (16 * segment)) - 1)
        high = prints >> np.uint64(16 * segment + 16) if segment < 3 else np.zeros_like(prints)
        rest = (low | high << np.uint64(16 * segment)).astype(np.int64)
        exact = (prints >> np.uint64(16 * segment) & np.uint64(0xFFFF)).astype(np.int64)
        for window in range(2):
            near = codewords_near(rest >> (23 * window) & 0x7FFFFF)
            head = (segment * 2 + window) << 28 | exact[:, None] << 12
            out[:, segment, window] = np.where(near >= 0, head | near, -1)
    return out.reshape(len(prints), 48)


def _fingerprints(shingle: int, verify_shingle: int | None):
    def run(batches):
        shingles = similarity.Shingles(verify_shingle or shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                columns, names = [part.column(0), pa.array(prints)], ["doc_id", "print"]
                if verify_shingle:
                    words = [shingles.words(t) for t in texts]
                    sets = [shingles.set_of(w) for w in words]
                    sizes = np.array([len(s) for s in sets], np.int64)
                    marks = np.array([similarity.signature(s) for s in sets], np.int64).reshape(-1, len(similarity.MARKS))
                    columns += [pa.array([shingles.digest(w) for w in words], pa.int64()), *(pa.array(np.ascontiguousarray(m)) for m in marks.T)]
                    columns += [pa.array(sizes), pa.array(similarity.signatures(np.concatenate(sets), sizes), pa.binary())]
                    names += ["digest", *similarity.MARKS, "n", "signature"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, verify_shingle: int | None = None) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long); with verify_shingle also digest (of the words) and the marks, the size and the signature of the set of such shingles."""
    more = "".join(f", {name} long" for name in ("digest", *similarity.MARKS, "n")) + ", signature binary" if verify_shingle else ""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle, verify_shingle), "doc_id long, print long" + more)


def _keyed(batches):
    for batch in batches:
        prints = batch.column(1).to_numpy(zero_copy_only=False)
        keys = fuzzy_keys(prints.view(np.uint64))
        row, slot = np.nonzero(keys >= 0)
        reps = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(keys[row, slot].astype(np.int32)), pa.array(reps[row]), pa.array(prints[row])], ["key", "rep", "print"])


def _first_shared(x: Column) -> Column:
    """The segment and window by which a linked pair with differing bits x is reported."""
    segments = [F.shiftrightunsigned(x, 16 * s).bitwiseAND(0xFFFF) == 0 for s in range(4)]
    out = F.lit(None).cast("int")
    for s in reversed(range(4)):
        low, high = x.bitwiseAND((1 << (16 * s)) - 1), F.shiftrightunsigned(x, 16 * s + 16) if s < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(F.shiftleft(high, 16 * s))
        window = F.when(F.bit_count(rest.bitwiseAND(0x7FFFFF)) <= F.bit_count(F.shiftright(rest, 23).bitwiseAND(0x7FFFFF)), 0).otherwise(1)
        out = F.when(segments[s], window + 2 * s).otherwise(out)
    return out


def linked_pairs(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a < b (rep) of the nodes (rep, print) whose prints differ in at most max_bits <= 3 bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the fuzzy keys cover at most three differing bits")
    keys = nodes.select("rep", "print").mapInArrow(_keyed, "key int, rep long, print long")
    a, b = keys.alias("a"), keys.alias("b")  # alike below the join, so Spark shuffles the keys once
    differ = F.col("a.print").bitwiseXOR(F.col("b.print"))
    here = (F.col("a.rep") < F.col("b.rep")) & (F.bit_count(differ) <= max_bits)
    once = F.shiftright(F.col("a.key"), 28).bitwiseAND(7) == _first_shared(differ)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & here & once)
    return pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of the nodes of an edge list (a, b).

    Alternates large-star and small-star until the edges stay as they are; every round
    is checkpointed in the shared folder, so a lost executor costs no earlier round.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m")).filter("n <> m").distinct())
    sign = F.struct(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("n", "m").cast("decimal(38,0)")), F.lit(0)))
    before = edges.agg(sign.alias("s")).first()["s"]
    while True:
        both = edges.unionByName(edges.select(F.col("m").alias("n"), F.col("n").alias("m")))
        least = both.groupBy("n").agg(F.least("n", F.min("m")).alias("least"))
        large = both.join(least, "n").filter("m > n").select(F.col("m").alias("n"), F.col("least").alias("m")).filter("n <> m").distinct()
        least = large.groupBy("n").agg(F.min("m").alias("least"))
        small = large.join(least, "n").select(F.explode(F.array(F.struct(F.col("m").alias("n"), F.col("least").alias("m")), F.struct("n", F.col("least").alias("m")))).alias("e"))
        edges = checkpointed(small.select("e.n", "e.m").filter("n <> m").distinct())
        after = edges.agg(sign.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    return edges.select(F.col("n").alias("node"), F.col("m").alias("component"))


def grouped(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, min_similarity: float | None = None, verify_shingle: int = 5, tables: Tables | None = None) -> DataFrame:
    """doc_id, digest, print, group, component_id of every row.

    Rows of one group belong together; component_id is their smallest doc_id, null where
    none has one.  Equal fingerprints (or texts of equal words) are one node of the graph,
    and nodes that very many rows share reach their rows by a bounded broadcast.  With
    tables, what the result reads is kept in these.
    """
    verify = min_similarity is not None
    put = tables.put if tables else lambda df, slot: checkpointed(df)
    own = put(fingerprints(docs, shingle, verify_shingle if verify else None), "own")
    node = "digest" if verify else "print"
    marks = [F.first(m).alias(m) for m in (*similarity.MARKS, "n", "signature")] if verify else []
    nodes = put(own.groupBy(node).agg(F.min("print").alias("of_print"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), *marks), "nodes")
    own = own.select("doc_id", (F.col("digest") if verify else F.lit(0).cast("long")).alias("digest"), "print")
    if verify:
        leads = put(nodes.groupBy("of_print").agg(F.min("digest").alias("lead"), F.count(F.lit(1)).alias("texts")), "leads")
        close = linked_pairs(leads.select(F.col("of_print").alias("rep"), F.col("of_print").alias("print")), max_bits)
        named = [leads.select(F.col("of_print").alias(x), F.col("lead").alias(f"lead_{x}")) for x in "ab"]
        across = close.join(named[0], "a").join(named[1], "b").select("lead_a", "lead_b")
        alike = heavy_join(nodes.select("digest", "of_print"), leads, "of_print", "texts", "lead").filter("digest <> lead").select("digest", "lead")
        proposed = across.union(alike).toDF("a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        reps = nodes.select(F.col("digest").alias("node"), "rep", *similarity.MARKS, "n", "signature")
        found = similarity.linked(docs.select("doc_id", "text"), proposed, reps, own.count(), min_similarity, verify_shingle, components)
    else:
        found = components(linked_pairs(nodes.select(F.col("print").alias("rep"), "print"), max_bits))
    placed = put(nodes.join(found, nodes[node] == found["node"], "left").select(F.col(node).alias("of_node"), "rep", "rows", F.coalesce("component", nodes[node]).alias("group")), "placed")
    groups = put(placed.groupBy("group").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "groups")
    placed = put(heavy_join(placed, groups, "group", "n", "component_id"), "named")
    both = placed.select(F.col("of_node"), "rows", F.struct("group", "component_id").alias("of"))
    return heavy_join(own.withColumn("node_key", F.col(node)), both.withColumnRenamed("of_node", "known_node"), ("node_key", "known_node"), "rows", "of").select("doc_id", "digest", "print", "of.group", "of.component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, min_similarity: float | None = None, verify_shingle: int = 5) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable).

    Documents link where their fingerprints differ in max_bits bits or fewer.  With
    min_similarity (above 0) the fingerprints only propose: documents link where their
    sets of verify_shingle words have that Jaccard similarity, and all such pairs are found.
    Null and empty texts have fingerprint zero and link like any other; repeated doc_ids
    give repeated rows, each linked by its own text; rows without a doc_id link like any
    other and keep the null, and a component of such rows alone has a null component_id;
    an empty table gives an empty result; further columns of docs are not looked at.
    """
    rows = grouped(docs.select("doc_id", "text"), shingle, max_bits, min_similarity, verify_shingle)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def _unused(names: list[str], name: str) -> str:
    return name if name not in names else _unused(names, name + "_")


def _with_digest(names: list[str], added: str):
    def run(batches):
        shingles = similarity.Shingles(SHINGLE)
        for batch in batches:
            same = [shingles.digest(shingles.words(t)) for t in batch.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.int64())], [*batch.schema.names, added])

    return run


def distinct_rows(docs: DataFrame, min_similarity: float, verify_shingle: int = 5) -> DataFrame:
    """docs with one row of each near-duplicate component: that of the smallest doc_id.

    Of rows that repeat this doc_id the one of the smallest digest of words stays, of those
    with the same words the first by text and further columns; rows without a doc_id stay
    only where no row of the component has one; rows keep their columns.
    """
    tables = Tables(docs.sparkSession, "simhash")
    rows = checkpointed(grouped(docs.select("doc_id", "text"), min_similarity=min_similarity, verify_shingle=verify_shingle, tables=tables).select("doc_id", "digest", "group"))
    tables.done()
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("c")).select(F.col("c.doc_id").alias("near_id"), F.col("c.digest").alias("near_digest"))
    again = checkpointed(rows.groupBy(F.col("doc_id").alias("again_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or again_id is null").select("again_id"))
    once = first.join(again, F.col("near_id").eqNullSafe(F.col("again_id")), "left_anti").select(F.col("near_id").alias("kept_id"))
    kept = docs.join(once, docs["doc_id"] == once["kept_id"], "left_semi")
    if not again.limit(1).count():
        return kept
    names = docs.columns
    repeated = docs.join(again, docs["doc_id"].eqNullSafe(again["again_id"]), "left_semi")
    digest, place = _unused(names, "near_digest"), _unused(names, "near_place")
    marked = repeated.mapInArrow(_with_digest(names, digest), T.StructType([*docs.schema.fields, T.StructField(digest, T.LongType())]))
    chosen = first.select("near_id", F.col("near_digest").alias("chosen_digest"))
    same = marked["doc_id"].eqNullSafe(chosen["near_id"]) & (marked[digest] == chosen["chosen_digest"])
    order = ["text", *(f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name != "text")]
    numbered = marked.join(chosen, same, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(*order)))
    return kept.unionByName(numbered.filter(F.col(place) == 1).select(*names))
