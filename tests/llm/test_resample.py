"""Importance resampling: features, gains, scores and ranks against plain Python."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from repolytics.llm import importance
from repolytics.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF

LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(docs, target, percent=25, least=20):
    s, t = ([0] * 10_000 for _ in range(2))
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    all_s, all_t = sum(s) + 10_000, sum(t) + 10_000
    gain = [math.floor(1000 * math.log((float(y + 1) * all_s) / (float(x + 1) * all_t))) for x, y in zip(s, t)]
    rows = []
    for i, text in docs:
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    can = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {}
    for place, r in enumerate(can[: len(can) * percent // 100], 1):
        ranks.setdefault(r, []).append(place)
    return sorted(((*r[:4], ranks[r].pop(0) if ranks.get(r) else None) for r in rows), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ09 .-_\x00\x7fé日\n@[`{"), max_size=30), max_size=6), st.integers(0, 2))
def test_words_and_pairs_of_any_texts(texts, skipped):
    array = pa.array(["no", None, *texts], pa.string()).slice(min(skipped, len(texts)))
    rows = array.to_pylist()
    got = [[] for _ in rows]
    words = []
    for at, to, data, offsets in importance.blocks(array):
        n, of, found = importance.block_features(data, offsets, 10_000)
        words += n.tolist()
        for x, b in zip(of.tolist(), found.tolist()):
            got[at + x].append(b)
    assert words == [len(features(t)[0]) for t in rows]
    assert [sorted(x) for x in got] == [sorted(map(bucket, features(t)[1])) for t in rows]


def test_words_longer_than_those_that_advance_together_and_blocks(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_WORDS", 7)
    monkeypatch.setattr(importance, "BLOCK_BYTES", 300)
    r = random.Random(3)
    texts = [" ".join("x" * r.choice([1, 2, 63, 64, 65, 200]) + str(r.randint(0, 99)) for _ in range(r.randint(0, 30))) for _ in range(40)]
    got = []
    for _, _, data, offsets in importance.blocks(pa.array(texts)):
        got += importance.block_features(data, offsets, 10_000)[2].tolist()
    assert sorted(got) == sorted(bucket(f) for t in texts for f in features(t)[1])


def test_ranks_equal_plain_python(spark, docs, texts):
    target = [made for _, made in texts[6:12]] + [None, ""]
    frame = spark.createDataFrame([(t, 5) for t in target], "text string, score int")
    got = [tuple(r) for r in importance.rank_documents(docs, frame).collect()]
    assert sorted(got, key=repr) == plain(texts, target)
    drawn = importance.resample(docs, frame)
    assert drawn.columns == docs.columns
    assert sorted(r["doc_id"] for r in drawn.collect()) == sorted(r[0] for r in got if r[4] is not None)


def test_odd_rows(spark, no_docs):
    rows = [(None, "a b " * 20), (None, "a b " * 20), (3, "a b " * 20), (3, "c d " * 15), (4, None), (5, ""), (6, "!!"), (7, "w" * 300_000 + " x" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    empty = spark.createDataFrame([], "text string")
    got = [tuple(r) for r in importance.rank_documents(docs, empty, percent=60).collect()]
    assert sorted(got, key=repr) == plain(rows, [], percent=60)
    assert importance.rank_documents(no_docs, docs).count() == 0
    assert importance.resample(no_docs, docs).count() == 0
    few = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert [r["rank"] for r in importance.rank_documents(few, few).collect()] == [None]


def test_query_equals_its_sql(spark):
    got = QUERIES["op11_resample"](spark, SF)
    own = duckdb.connect()
    for name in ("documents", "benchmark"):
        own.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = own.execute(ORACLE_SQL["op11_resample"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.columns == [d[0] for d in own.description]


@pytest.mark.parametrize("n", [1, 5])
def test_ranks_do_not_depend_on_partitions(spark, n):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = sorted(map(tuple, importance.rank_documents(docs.repartition(n), target).collect()))
    ranks = sorted(r[4] for r in rows if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1))
    assert np.array_equal(rows, sorted(map(tuple, QUERIES["op11_resample"](spark, SF).collect())))
