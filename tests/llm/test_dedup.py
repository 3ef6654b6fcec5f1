"""SimHash components and substring removal against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import xxhash

from repolytics.llm import simhash, substring


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_print(text):
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    grams = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) > 2 else [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, x), (j, y) in combinations(zip(ids, prints), 2):
        if linked(x, y):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_golay_words_at_distance_two_share_a_codeword():
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 23, 4000)
    for n in (0, 1, 2):
        y = x.copy()
        for row in range(len(y)):
            for bit in r.choice(23, n, replace=False):
                y[row] ^= 1 << int(bit)
        a, b = simhash.codewords_near(x), simhash.codewords_near(y)
        assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(a, b))


def test_fuzzy_keys_meet_for_every_three_bit_difference():
    r = random.Random(5)
    for _ in range(3000):
        x = r.getrandbits(64)
        y = x
        for bit in r.sample(range(64), r.randint(0, 3)):
            y ^= 1 << bit
        a, b = simhash.fuzzy_keys(np.array([x, y], np.uint64))
        assert set(a[a >= 0]) & set(b[b >= 0])


def test_components_equal_brute_force(docs, texts):
    rows = simhash.near_duplicates(docs).collect()
    prints = {i: slow_print(t) for i, t in texts}
    want = groups(list(prints), list(prints.values()), lambda x, y: (x ^ y).bit_count() <= 3)
    assert len(rows) == len(texts)
    for r in rows:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


def test_planted_links_are_found(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 3))) for b in base]
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)], "rep long, print long")
    got = {(p["a"], p["b"]) for p in simhash.linked_pairs(nodes).collect()}
    assert got == {(i, j) for (i, x), (j, y) in combinations(enumerate(prints), 2) if (x ^ y).bit_count() <= 3}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(205, 201), (201, 203)]
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and all(got[k] == 100 for k in range(101, 160)) and got[203] == got[205] == 201


def test_similarity_keeps_unlike_texts_apart(docs, texts):
    rows = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, min_similarity=0.8).collect()}
    assert rows[10] == rows[11] == rows[12] == 10 and rows[40] == rows[44] == 20 and rows[13] == rows[14] == 13


def test_chain_of_near_copies_is_one_component(spark):
    """Each text is similar to the one before it only, which is seldom its component's smallest."""
    r = random.Random(23)
    own, texts = [f"w{r.randrange(400)}" for _ in range(204)], []
    for step in range(24):
        texts.append(" ".join(own))
        for at in range(4):
            own[step * 4 + at * 50 if step < 12 else (step - 12) * 4 + at * 50 + 2] = f"x{step}y{at}"
    ids = r.sample(range(24), 24)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(200)} for t in texts]
    want = groups(ids, sets, lambda x, y: len(x & y) >= 0.8 * len(x | y))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, min_similarity=0.8).collect()}
    assert got == want and set(want.values()) == {0}


def test_all_similar_pairs_are_joined(spark):
    """Different texts about the limit, alone, in chains and in a dense group, against all pairs."""
    r = random.Random(17)
    texts = []
    for _ in range(25):
        one = [f"w{r.randrange(400)}" for _ in range(r.choice((30, 80, 200)))]
        for changes in (0, 1, 2, 3, 4, 6):
            own = list(one)
            for at in r.sample(range(len(own)), min(changes * len(one) // 80 + (changes > 0), len(own))):
                own[at] = f"x{r.randrange(10_000)}"
            texts.append(" ".join(own))
    core = [f"c{r.randrange(300)}" for _ in range(150)]
    for _ in range(80):
        own = list(core)
        for at in r.sample(range(150), r.randint(0, 6)):
            own[at] = f"y{r.randrange(10_000)}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = groups(range(len(texts)), sets, lambda x, y: len(x & y) >= 0.8 * len(x | y))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, min_similarity=0.8).collect()}
    assert got == want


def test_one_row_of_each_group_stays(spark):
    r = random.Random(29)
    own = lambda: " ".join(f"w{r.randrange(10_000)}" for _ in range(60))
    a, b, c = own(), own(), own()
    near = a.replace(a.split()[30], "other", 1)
    rows = [(7, a), (3, near), (9, a), (None, a), (4, b), (4, b + "  "), (4, c), (None, None), (5, ""), (None, own()), (6, "short one"), (8, "Short ONE")]
    frame = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, near_digest int, near_place string").repartition(3)
    got = simhash.distinct_rows(frame, 0.8)
    assert got.columns == frame.columns
    kept = sorted((str(x["doc_id"]), (x["text"] or "")[:5]) for x in got.collect())
    assert kept == sorted([("3", near[:5]), ("4", b[:5]), ("4", c[:5]), ("5", ""), ("None", rows[9][1][:5]), ("6", "short")])
    assert simhash.distinct_rows(frame.limit(0), 0.8).count() == 0


def test_word_hashes_depend_on_the_words_alone():
    from repolytics.llm import similarity

    powers, text = substring.Powers(), " a bb\ta  ccc\n\x0bbb é日本 a "
    got = similarity.word_hashes(text.encode(), powers)
    assert len(got) == 7 and got[0] == got[2] == got[6] and got[1] == got[4] and len(set(got.tolist())) == 4
    for block in (1, 2, 5):
        assert similarity.word_hashes(text.encode(), powers, block).tolist() == got.tolist()
    shingles = similarity.Shingles(3)
    digest = lambda t: shingles.digest(shingles.words(t))
    assert digest("A b\nC") == digest("a  B c ") != digest("a b") and digest("") == digest(None) and len(shingles("a b c d e c d e")) == 5


def test_signatures_differ_no_more_than_the_sets():
    from repolytics.llm import similarity

    r = np.random.default_rng(6)
    for _ in range(300):
        x = np.unique(r.integers(0, 1 << 63, 200).astype(np.uint64))
        y = np.union1d(x[r.random(len(x)) < r.random()], r.integers(0, 1 << 63, r.integers(0, 40)).astype(np.uint64))
        a, b = (similarity.signature(s).view(np.uint64) for s in (x, y))
        assert sum(int(v).bit_count() for v in a ^ b) <= len(np.setxor1d(x, y))


def test_sets_of_unlike_texts_are_not_shuffled(spark, monkeypatch):
    """Long texts that lead with one shingle: their marks of 256 bits allow every pair, their signatures none but the planted one."""
    from repolytics.llm import similarity

    r, ends, slots_of = random.Random(31), [], similarity.slots_of
    first = min((f"a{i} b c d e" for i in range(5000)), key=lambda x: similarity.Shingles(5)(x)[0])
    texts = [" ".join([first, *(f"w{r.randrange(10**9)}" for _ in range(1200 + 10 * i))]) for i in range(30)]
    texts.append(texts[7] + " one more")
    monkeypatch.setattr(similarity, "slots_of", lambda ids, column: ends.append(ids.count()) or slots_of(ids, column))
    monkeypatch.setattr(similarity, "common_shingles", lambda *_: (np.array([2**64 - 1], np.uint64), np.zeros(1, np.int32)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, min_similarity=0.8).collect()}
    assert found == {i: 7 if i == 30 else i for i in range(31)} and ends == [2, 0]


def test_keys_of_texts_that_fit_no_other_go(spark, monkeypatch):
    from repolytics.llm import similarity

    r = random.Random(37)
    rare = "z1 z2 z3 z4 z5"
    own = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    one, other = f"{own(30)} {rare}", f"{own(300)} {rare}"
    monkeypatch.setattr(similarity, "common_shingles", lambda *_: (np.array([2**64 - 1], np.uint64), np.zeros(1, np.int32)))
    monkeypatch.setattr(similarity, "front", lambda n, least: n)
    keys = lambda *texts: similarity.shared_keys(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), 2, 0.8, 5).count()
    assert keys(one, other) == 0 and keys(one, f"{one} more") > 0
    assert similarity.fitting(np.zeros(0, similarity._ROW), 0.8).tolist() == []
    for _ in range(300):
        rows = np.zeros(r.randrange(1, 9), similarity._ROW)
        for row in rows:
            n = r.randrange(1, 60)
            row["key"], row["n"], row["place"], row["state"] = r.randrange(3), n, r.randrange(similarity.front(n, 0.8)), r.random() < 0.1
        rows = rows[np.argsort(rows["key"], kind="stable")]
        kept = similarity.fitting(rows, 0.8)
        for i, a in enumerate(rows):
            others = [b for j, b in enumerate(rows) if j != i and b["key"] == a["key"]]
            fit = [b for b in others if 1.8 * min(int(a["n"]) - a["place"], int(b["n"]) - b["place"]) >= 0.8 * (int(a["n"]) + int(b["n"])) - 1e-6]
            shared = any(b["state"] == similarity.SHARED for b in [a, *others])
            assert kept[i] or not (fit or shared)
            assert len(others) != 1 or shared or kept[i] == bool(fit)


def test_no_tables_of_the_steps_are_left(spark):
    import os

    from repolytics.llm.common import local_path, shared_folder

    docs = spark.createDataFrame([(i, f"{w} b c d e f {w} h") for i, w in enumerate("xyxz")], "doc_id long, text string")
    kept = simhash.distinct_rows(docs, 0.8)
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, 1, 3]
    assert not [f for f in os.listdir(local_path(shared_folder(spark))) if f.startswith(("similarity-", "simhash-"))]


def test_a_shared_passage_makes_no_large_group(spark):
    """One passage in 50,000 documents: each bucket holds a block's entry of it, not the documents'."""
    passage = " ".join(f"p{i}" for i in range(14))
    docs = spark.range(50_000).selectExpr("id as doc_id", f"concat('{passage} tail', id) as text").repartition(4)
    rows = substring.dealt_windows(docs, bucket_bytes=1 << 30).selectExpr("bucket", "octet_length(hashes) / 8 as n").groupBy("bucket").sum("n").collect()
    total, most = sum(r[1] for r in rows), max(r[1] for r in rows)
    assert total >= 100_000 and most <= total / 4
    found = {r["doc_id"]: r["n_removed"] for r in substring.deduplicate(docs).collect()}
    assert found[0] == 0 and all(found[i] == 14 for i in range(1, 50_000))


def test_substring_equals_its_sql(spark):
    import duckdb

    from repolytics.llm import queries
    from tests.conftest import SF

    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = duckdb.sql(substring.ORACLE)
    got = queries.op6_substring(spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(20))
    frame = spark.createDataFrame([(None, text), (5, text), (None, text), (7, text)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in substring.deduplicate(frame).collect()) == [("5", 0), ("7", 20), ("None", 0), ("None", 0)]
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()} == {(None, 5), (5, 5), (7, 5)}
    alone = spark.createDataFrame([(None, "quite alone here")], "doc_id long, text string")
    assert [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(alone).collect()] == [(None, None)]


def test_removed_windows_equal_brute_force(docs, texts):
    first = {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        own = words(t)
        for k in range(len(own) - 12):
            first.setdefault(tuple(own[k : k + 13]), i)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(docs).collect())
    want = []
    for i, t in texts:
        own = words(t)
        gone = [False] * len(own)
        for k in range(len(own) - 12):
            if first[tuple(own[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = [w for w, g in zip(own, gone) if not g]
        want.append((i, len(own), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert got == sorted(want)


def test_cleaned_rows_keep_columns_and_cut_passages(docs, texts):
    rows = {r["doc_id"]: r for r in substring.cleaned_rows(docs.filter("doc_id <> 20")).collect()}
    assert docs.columns == list(next(iter(rows.values())).asDict())
    assert 41 not in rows and rows[10]["text"] is None and len(rows[60]["text"].split()) == 120
    assert len(rows[61]["text"].split()) == 60 and rows[61]["n_chars"] == len(rows[61]["text"])


def test_spans_are_maximal():
    assert substring.spans_of(np.array([0, 1, 1, 0, 1], bool)) == [(1, 3), (4, 5)]
    assert substring.without("a b\n c d", [(1, 2)]) == "a\n c d" and substring.without("a b", [(0, 2)]) == ""


def test_empty_tables(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs, min_similarity=0.8).count() == 0
    assert substring.deduplicate(no_docs).count() == 0
    assert substring.cleaned_rows(no_docs).count() == 0
