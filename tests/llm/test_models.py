"""Language identification and quality: held-out accuracy, and odd inputs."""

import math
import random
import zlib

import numpy as np

from repolytics.llm import chargrams, langid, quality
from tests.conftest import SF


def test_grams_do_not_cross_boundaries():
    points, starts = chargrams.laid_out(["ab c", ""], "letters", True)
    found = [int((chargrams.grams(points, n, 1 << 17) > 0).sum()) for n in (1, 2, 3, 4)]
    assert found == [3, 5, 3, 1] and starts.tolist() == [0, 5]
    a, b = (chargrams.grams(chargrams.laid_out([t], "letters", True)[0], 3, 1 << 17) for t in ("xy word", "longer word"))
    assert set(a[4:8]) == set(b[8:12])


def test_word_hashes_depend_on_letters_and_order():
    _, h = chargrams.words(chargrams.laid_out(["ab ba ab", "ab"], "visible", False)[0])
    assert h[0] == h[2] == h[3] != h[1]


def test_long_texts_are_cut_between_words():
    text = "word " * 1000
    parts, owners = zip(*chargrams.pieces([text, None, "x"], 300))
    joined = [p for ps in parts for p in ps]
    assert "".join(joined[:-2]) == text and np.concatenate(owners)[-1] == 2


def slow_grams(text, kept, n, buckets):
    """The hashed n-grams of every run of kept characters between two boundaries."""
    out, word, m = [], [], (1 << 32) - 1
    for c in [*text, None]:
        if c is not None and kept(c):
            word.append(ord(c))
            continue
        padded = [0, *word, 0] if word else []
        for at in range(len(padded) - n + 1):
            own = padded[at : at + n]
            if n == 1 and own == [0]:
                continue
            h = (own[0] * 0x9E3779B1 + n) & m
            for x in own[1:]:
                h = ((h ^ h >> 15) * 0x85EBCA77 + x) & m
            h = ((h ^ h >> 13) * 0xC2B2AE3D) & m
            h ^= h >> 16
            out.append(max(h & (buckets - 1), 1))
        word = []
    return out


def test_language_equals_naive_bayes_by_hand(spark):
    known = [("the cat sat on the mat", "en"), ("a dog and a cat", "en"), ("le chat est sur le tapis", "fr"), ("un chien", "fr"), ("der Hund ist da", "de"), (None, "de"), ("x", None), ("42", "en")]
    asked = ["the dog", "Le chien, le chat!", "Hund und Katze", "naïve x2y", "123", None, "a" * 50]
    model = langid.train(spark.createDataFrame(known, "text string, lang string"), buckets=1 << 10)
    counts, rows = {}, {}
    for text, lang in known:
        if text is not None and lang is not None:
            rows[lang] = rows.get(lang, 0) + 1
            own = counts.setdefault(lang, [0.1] * 1024)
            for n in langid.ORDERS:
                for g in slow_grams(text.lower(), str.isalpha, n, 1024):
                    own[g] += 1
    for text, (lang, share) in zip(asked, langid.score(model, asked)):
        logs = {k: math.log(rows[k] / sum(rows.values())) + sum(math.log(own[g] / sum(own)) for n in langid.ORDERS for g in slow_grams((text or "").lower(), str.isalpha, n, 1024)) for k, own in counts.items()}
        if not any(c.isalpha() for c in text or ""):
            assert (lang, share) == ("und", 0.0)
            continue
        best = min(logs, key=lambda k: (-logs[k], k))
        assert lang == best and abs(share - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-4


def test_ties_of_languages_go_to_the_first_in_order(spark):
    model = langid.train(spark.createDataFrame([("same words", "zz"), ("same words", "aa")], "text string, lang string"))
    assert langid.score(model, ["same", "other"])[0] == ("aa", 0.5)


def test_quality_features_equal_a_plain_count():
    for text in ("a b b  b\tc", "Lorem ipsum, dolor ipsum", "", None, "x" * 30 + "\n" + "日本 日本"):
        ids, n = quality.counts_of(text, 1 << 10)
        want = {}
        for order in quality.ORDERS:
            for g in slow_grams(text or "", lambda c: not c.isspace(), order, 1 << 10):
                want[g] = want.get(g, 0) + 1
        words = (text or "").split()
        _, _, places, named, again = quality.features([text or ""], 1 << 10)
        assert len(places) == len(words) and again.tolist() == [i > 0 and words[i] == words[i - 1] for i in range(len(words))]
        seen = {}
        for word, bucket in zip(words, named.tolist()):
            assert seen.setdefault(word, bucket) == bucket
            want[bucket] = want.get(bucket, 0) + 1
        if again.sum():
            want[quality.REPEAT] = want.get(quality.REPEAT, 0) + int(again.sum())
        assert dict(zip(ids.tolist(), n.astype(int).tolist())) == want


def test_quality_training_equals_plain_loops():
    r = random.Random(3)
    rows = [(i % 3 == 0, np.array(sorted(r.sample(range(2, 12), 4)), np.int32), np.array([r.randint(1, 5) for _ in range(4)], np.float32)) for i in range(9)] + [(1, np.zeros(0, np.int32), np.zeros(0, np.float32))]
    rows = [(int(label), ids, n) for label, ids, n in rows]
    dim, buckets, epochs, rate = 3, 12, 4, 0.5
    model = quality.fit(rows, dim, buckets, epochs, rate)
    draws = np.random.default_rng(7)
    vectors = ((draws.random((buckets, dim), np.float32) - 0.5) / dim).astype(float).tolist()
    weights, bias = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0]
    tally = [sum(x[0] == c for x in rows) for c in (0, 1)]
    step = 0
    for _ in range(epochs):
        for k in draws.permutation(len(rows)):
            label, ids, n = rows[k]
            now, step = rate * (1 - step / (epochs * len(rows))), step + 1
            share = [x / sum(n) for x in n] if len(n) else []
            hidden = [sum(s * vectors[i][d] for s, i in zip(share, ids)) for d in range(dim)]
            logits = [sum(hidden[d] * weights[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
            top = [math.exp(x - max(logits)) for x in logits]
            balance = math.sqrt(len(rows) / (2 * tally[label]))
            wrong = [balance * (x / sum(top) - (c == label)) for c, x in enumerate(top)]
            back = [sum(weights[d][c] * wrong[c] for c in (0, 1)) for d in range(dim)]
            for d in range(dim):
                for c in (0, 1):
                    weights[d][c] -= now * hidden[d] * wrong[c]
            for c in (0, 1):
                bias[c] -= now * 0.1 * wrong[c]
            for s, i in zip(share, ids):
                for d in range(dim):
                    vectors[i][d] -= now * math.sqrt(len(ids)) * s * back[d]
    assert np.allclose(model.vectors, vectors, atol=1e-4) and np.allclose(model.weights, weights, atol=1e-4) and np.allclose(model.bias, bias, atol=1e-4)


def test_conflicting_labels_count_as_the_larger(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    assert sorted(x[0] for x in quality.training_rows(docs, labels, fold=7)) == [0, 1]


def test_training_rows_are_bounded_where_ids_repeat(spark):
    rows = [(1, "same words")] * 900 + [(1, f"other words {i}") for i in range(300)] + [(i, f"text {i}") for i in range(2, 60)] + [(3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as text_key", "2 as times", "3 as label")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert len(quality.training_rows(docs, labels, fold=7, most=100)) == 100
    every = quality.training_rows(docs, labels, fold=7, most=5000)
    wanted = sorted((i % 2, *(x.tobytes() for x in quality.counts_of(t))) for i, t in rows)
    assert sorted((label, ids.tobytes(), counts.tobytes()) for label, ids, counts in every) == wanted


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark, docs, no_docs):
    model = langid.train(spark.createDataFrame([("hello there you", "en"), ("bonjour à tous", "fr"), (None, "de"), ("x", None)], "text string, lang string"))
    assert model.languages == ["en", "fr"]
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert got[10]["lang_pred"] == got[11]["lang_pred"] == got[12]["lang_pred"] == "und" and got[10]["score"] == 0
    assert langid.score(model, ["bonjour", "1 2 3", "there you"])[0][0] == "fr"
    assert langid.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(no_docs)).collect()} == {"und"}


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_quality_scoring_equals_two_layers():
    r = np.random.default_rng(1)
    model = quality.Model(r.normal(size=(1 << 16, 4)).astype(np.float32), r.normal(size=(4, 2)).astype(np.float32), np.array([0.1, 0.3], np.float32))
    for text in ("a b b b", "Lorem ipsum dolor", "###"):
        ids, counts = quality.counts_of(text)
        z = (counts / counts.sum()) @ model.vectors[ids] @ model.weights + model.bias
        assert abs(quality.Scorer(model).scores([text])[0] - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-5


def test_quality_of_odd_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, none).collect()
    assert len(rows) == docs.count() and {r["predicted"] for r in rows} == {1}
    assert quality.classify(no_docs, none).count() == 0
    one = spark.createDataFrame([(20, 1, 0), (21, 0, 0), (21, 0, 0), (None, 1, 0), (22, None, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.training_rows(docs, one, fold=7)) == 3
    kept = quality.scored_rows(docs, quality.fit([]))
    assert kept.columns == [*docs.columns, "quality_score"]


def test_small_scale_reads(spark):
    assert langid.identify(spark.read.parquet(f"{SF}/documents.parquet")).count() == 200
