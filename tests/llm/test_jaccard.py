"""The n-gram Jaccard join against all pairs."""

import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from repolytics.llm import ngram_join, similarity
from repolytics.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def plain(rows, percent=80):
    """(doc_id, n_shingles, component_id) of (doc_id, text), by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    ids = {top: min((d for d in docs if d is not None), default=None) for top, docs in least.items()}
    return sorted(((doc, len(sets[i]), ids[find(i)]) for i, (doc, _) in enumerate(rows)), key=repr)


def changed(r, words, n):
    own = list(words)
    for at in r.sample(range(len(own)), min(n, len(own))):
        own[at] = f"x{r.randrange(10_000)}"
    return own


@pytest.fixture(scope="module")
def many():
    """Texts of every small size and some large ones, with copies, near copies, chains and a dense group."""
    r = random.Random(31)
    texts = []
    for n in [*range(1, 40), 60, 90, 130, 220, 400]:
        one = [f"w{r.randrange(300)}" for _ in range(n)]
        texts.append(one)
        for n_changes in (1, 1, 2, 3, max(1, n // 60), max(1, n // 45)):
            texts.append(changed(r, one, n_changes))
        texts += [one[: -max(1, n // 12)] or one, [*one, *(f"z{i}" for i in range(max(1, n // 9)))], one + one[: n // 2], one[::-1]]
    core = [f"c{r.randrange(300)}" for _ in range(150)]
    texts += [changed(r, core, r.randint(0, 6)) for _ in range(90)]
    texts = [" ".join(t) for t in texts]
    texts += [t.upper() for t in texts[::17]] + ["", "  \n", None]
    ids = r.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize(("light", "long"), [(None, None), (0, 2), (1 << 16, 3), (30, 64)])
def test_components_equal_all_pairs(spark, many, monkeypatch, light, long):
    """With the measured boundary, all heavy, all light and in between; long lists cut at different sizes."""
    if light is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda *_: min(light, 60) if light > 30 else light)
        monkeypatch.setattr(ngram_join, "LONG_LIST", long)
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in ngram_join.linked_documents(docs).collect()), key=repr)
    assert got == plain(many)


def test_other_similarities(spark, many):
    part = many[::3]
    docs = spark.createDataFrame(part, "doc_id long, text string")
    for percent in (55, 90, 100):
        assert sorted((tuple(r) for r in ngram_join.linked_documents(docs, percent).collect()), key=repr) == plain(part, percent)


def test_similar_sets_share_a_key():
    """Any similar pair meets at a light key, or at a heavy one where a set is above the boundary."""
    r = random.Random(2)
    common, counts = np.array([5, 9, 2**64 - 1], np.uint64), np.array([3, 2, 0])
    for _ in range(400):
        n, most_light = r.randint(4, 80), r.choice([0, 5, 12, 40, 100])
        x = [r.getrandbits(64) for _ in range(n)]
        y = x[: r.randint(int(n * 0.8), n)] + [r.getrandbits(64) for _ in range(r.randint(0, n // 5))]
        both = len(set(x) & set(y))
        if 100 * both < 80 * len(set(x) | set(y)) or set(x) == set(y):
            continue
        keys = []
        for own in (x, y):
            own = np.unique(np.array(own, np.uint64))
            sizes = np.array([len(own)])
            ordered, _ = ngram_join.in_order(own, sizes, common, counts)
            rows = ngram_join.keys_of(ordered, sizes, np.array([7]), 80, most_light)
            keys.append({int(k): int(n - p) for k, p, n in zip(rows["key"], rows["place"], rows["n"])})
        met = set(keys[0]) & set(keys[1])
        assert met
        assert max(min(keys[0][k], keys[1][k]) for k in met) >= both


def test_boundary_grows_with_the_lists():
    found = [ngram_join.boundary(x) for x in (0, 0.5, 2, 10, 100, 1000)]
    assert found == sorted(found) and found[0] < found[-1] and found[0] >= 3


def test_blocks_of_sets_equal_single_ones(texts):
    sets, one = ngram_join.Sets(5), similarity.Shingles(5)
    rows = [t for _, t in texts]
    seen = 0
    for at, to, grams, sizes in sets.blocks(pa.array(rows)):
        ends = np.cumsum(sizes)
        for i in range(at, to):
            own = grams[ends[i - at] - sizes[i - at] : ends[i - at]]
            assert len(own) == len(shingles(rows[i]))
            if len(own):
                assert np.array_equal(own, one(rows[i]))
            seen += 1
    assert seen == len(rows)


def test_odd_rows(spark, docs, texts, no_docs):
    got = sorted((tuple(r) for r in ngram_join.linked_documents(docs).collect()), key=repr)
    assert got == plain(texts)
    assert ngram_join.linked_documents(no_docs).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (5, text + " more"), (None, text), (7, "one two"), (7, "one two"), (None, ""), (None, "quite alone here today is this"), (8, None), (8, None)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, n_shingles int")
    assert sorted((tuple(r) for r in ngram_join.linked_documents(frame).collect()), key=repr) == plain(rows)


def test_query_equals_its_sql(spark):
    got = QUERIES["op12_jaccard"](spark, SF)
    own = duckdb.connect()
    own.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = own.execute(ORACLE_SQL["op12_jaccard"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.columns == [d[0] for d in own.description]
    assert len({r[2] for r in want}) < len(want)


def test_signatures_differ_no_more_than_the_sets():
    r = np.random.default_rng(6)
    for _ in range(200):
        x = np.unique(r.integers(0, 1 << 63, r.integers(1, 3000)).astype(np.uint64) << np.uint64(1))
        y = np.union1d(x[r.random(len(x)) < r.random()], r.integers(0, 1 << 63, r.integers(1, 300)).astype(np.uint64))
        signs = [np.unpackbits(np.frombuffer(s, np.uint8)) for s in ngram_join.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]))]
        assert [len(s) for s in signs] == ngram_join.signature_bits(np.array([len(x), len(y)])).tolist()
        width = min(map(len, signs))
        differ = int((ngram_join.folded(signs[0], width) ^ ngram_join.folded(signs[1], width)).sum())
        assert differ <= len(np.setxor1d(x, y)) and (differ - len(np.setxor1d(x, y))) % 2 == 0
