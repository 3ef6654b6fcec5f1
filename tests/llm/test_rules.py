"""Quality rules, decontamination and the pipeline."""

import random
import re
from collections import Counter

import corpus_pipeline
from repolytics.llm import decontaminate, quality, quality_rules
from tests.conftest import SF


def base(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(own, own[1:], own[2:]))
    covered = {p for i, w in enumerate(zip(own, own[1:], own[2:])) if seen[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_rules_equal_brute_force(docs, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted((r["doc_id"], *(r[n] for n in names)) for r in quality_rules.judge(docs).collect())
    assert got == sorted((i, *base(t)) for i, t in texts)


def test_common_lines_deplete_documents(spark):
    line = " ".join(f"w{i}" for i in range(60))
    own = lambda k: " ".join(f"u{k}x{i}" for i in range(55))
    rows = [(i, line, "h") for i in range(12)] + [(20 + i, own(i) + "\n" + line.upper() + " ", "h") for i in range(12)] + [(40, line, None), (41, None, "h"), (None, own(9), "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judge(frame, most_docs=5).collect()}
    assert not any(got[i]["kept"] for i in range(12)) and got[0]["n_words_removed"] == 60
    assert got[20]["n_words_removed"] == 60 and not got[20]["kept"] and got[40]["kept"] and not got[41]["kept"] and got[None]["kept"]
    assert all(r["kept"] for i, r in ((i, r) for i, r in {r["doc_id"]: r for r in quality_rules.judge(frame, most_docs=30).collect()}.items()) if i is not None and i < 40)
    assert quality_rules.judge(frame.limit(0)).count() == 0


def test_line_limit_equals_brute_force(spark, monkeypatch):
    random.seed(5)
    stock = [" ".join(f"s{k}x{i}" for i in range(12)) for k in range(12)]
    rows = []
    for i in range(160):
        own = [" ".join(f"d{i}l{j}w{k}" for k in range(9)) for j in range(random.randrange(1, 7))]
        lines = own + [random.choice([x, " " + x.upper(), x.replace(" ", "\t ") + "\r"]) for x in random.sample(stock, random.randrange(0, 6))]
        rows.append((random.choice([i, i, 7, None]), random.choice([random.shuffle(lines), "\n".join(lines), "\n \n".join(lines)][1:]), random.choice("ab") if i % 9 else None))
    rows += rows[:25] + [(rows[0][0], rows[0][1], "b"), (rows[0][0], rows[0][1], "c")] + [(900 + i, "\n".join(stock), "a") for i in range(40)]
    rows += [(i, None, "a") for i in range(3)] + [(5, "", None), (6, "\n\n \t", "a")]

    def lines_of(text):
        return [x for x in (" ".join(re.findall(r"[^\x20\x09-\x0D]+", y)).lower() for y in (text or "").split("\n")) if x]

    held = {}
    for _, text, host in rows:
        for x in lines_of(text):
            held.setdefault((host or "", x), set()).add(text)
    wanted = []
    for doc, text, host in rows:
        removed = sum(len(x.split(" ")) for x in lines_of(text) if len(held[host or "", x]) > 9)
        n, *_, failed = base(text)
        wanted.append((str(doc), n, removed, not failed and removed <= 0.5 * n))
    assert any(r > 0 for _, _, r, _ in wanted)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as line_host", "2 as text_key", "3 as n_words")
    for most in (quality_rules.MOST_BROADCAST, 0):
        monkeypatch.setattr(quality_rules, "MOST_BROADCAST", most)
        got = [(str(r["doc_id"]), r["n_words"], r["n_words_removed"], r["kept"]) for r in quality_rules.judge(frame, most_docs=9).collect()]
        assert sorted(got) == sorted(wanted)


QUESTION = "A farmer named Alice Brown sold 12 kg of apples on monday and then 30 kg on friday to Bob so how many kg did she sell in all"


def test_reparameterised_questions_are_caught(spark):
    same = QUESTION.replace("Alice Brown", "Maria Lopez").replace("12", "450").replace("30", "77").replace("Bob", "Ivan")
    odd = QUESTION.replace("of apples", "of pears").replace("on friday to", "by sunday for").replace("sold", "bought").replace("how many", "what")
    rows = [(1, "intro text. " + QUESTION + " more"), (2, same), (3, odd), (4, None), (5, ""), (6, "the and of " * 2000), (7, same), (7, same)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as hash")
    items = spark.createDataFrame([(9, QUESTION), (10, None), (11, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 9), (2, 9), (7, 9)}
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items, block_windows=3).collect()}
    assert blocks == got
    assert decontaminate.contaminated(docs.limit(0), items).count() == decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_inconsistent_slots_do_not_count(spark):
    item = "add 5 to the first box then take 5 from the second box and put 5 on the shelf near the door"
    good, bad = item.replace("5", "8"), item.replace("5", "8", 1).replace("take 5", "take 6").replace("put 5", "put 7")
    rows = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contaminated(rows, spark.createDataFrame([(3, item)], "item_id long, text string"), least_coverage=0.0).collect()}
    assert found[1]["n_inconsistent"] == 0 and found[1]["coverage"] == 1.0
    assert found[2]["n_inconsistent"] > 0 and found[2]["coverage"] < 1.0


def test_short_items_match_verbatim_and_dense_ones_by_template(spark):
    items = ["What is the capital of France?", "Solve for x: 3 x + 7 = 22", "Compute 12 + 48 - 7 + 19 x 3 - 56 + 81 - 14 + 9.", "What is the next number in 2 3 5 7 11 13 17 19 23 29 31 37 41 43 47 53?", "Der Bau der Brücke über den Fluss Rhein bei der Stadt Köln", "1 2 3 4 5 6 7 8 9 10"]
    docs = [(i, f"some words before it {t} and some after") for i, t in enumerate(items)]
    docs += [(10, "What is the capital of Spain?"), (12, "capital of France"), (13, ""), (15, "9 8 7 6 5 4 3 2 1 0 9 8 7 6")]
    docs += [(11, "Compute 13 + 49 - 8 + 20 x 4 - 57 + 82 - 15 + 10."), (14, "What is the next number in 4 6 10 14 22 26 34 38 46 58 62 74 82 86 94 106?")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.contaminated(frame, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(len(items))} | {(11, 2), (14, 3)} and all(r["coverage"] <= 1.0 for r in found)


def slow_tokens(text):
    """(kind, token) of the words of a text: a literal, or a placeholder with its value."""
    out, start, number = [], True, False
    for word in (text or "").split():
        core = re.sub(r"^[\W_]+|[\W_]+$", "", word)
        ends = word.rstrip("\"')]}»”’").endswith((".", "!", "?", ":", "…"))
        if core:
            kind = ""
            if len(core) > 1 and core[0].isupper() and not core.isupper() and not start:
                kind = "name"
            if re.match(r"^[-+]?[\d][\d.,:/]*(?:st|nd|rd|th)?$", core):
                kind = "number"
            if number and core.lower() in decontaminate.UNITS:
                kind = "unit"
            number = bool(re.match(r"^[-+]?[\d][\d.,:/]*(?:st|nd|rd|th)?$", core))
            out.append((kind, core.lower()))
        start = ends
    return out


def slow_windows(tokens, real):
    return tuple(t for t in tokens) if real else tuple(k or t for k, t in tokens)


def slow_leak(item, doc, coverage):
    """By definition: every window of the item at every place of the document."""
    a, b = slow_tokens(item), slow_tokens(doc)
    if not a:
        return None
    kinds = [0 if not k else 1 for k, _ in a]
    n, rows = len(a), []
    few = lambda s, w: kinds[s : s + w].count(0) < 4
    windows = [(0, n, True)] if n < 8 else [(s, 8, True) for s in range(n - 7) if few(s, 8)]
    covered, width, last = set(), 8, 8
    while width <= n:
        now = [s for s in range(n - width + 1) if not few(s, width) and not set(range(s, s + width)) <= covered]
        windows += [(s, width, False) for s in now]
        covered |= {p for s in now for p in range(s, s + width)}
        last, width = width, width + width // 2
    if n >= 8 and len(covered) < n and kinds.count(0) >= 2:
        windows += [(s, last, False) for s in {0, n - last} if 0 in kinds[s : s + last]]
    for s, w, real in set(windows):
        mine = slow_windows([(None, t) for _, t in a[s : s + w]] if real else a[s : s + w], real)
        for at in range(len(b) - w + 1):
            if slow_windows([(None, t) for _, t in b[at : at + w]] if real else b[at : at + w], real) == mine:
                slots = [] if real else [(k + x, k + y) for (k, x), (_, y) in zip(a[s : s + w], b[at : at + w]) if k]
                rows.append((s, w, real, slots))
    votes = {}
    for *_, slots in rows:
        for x, y in slots:
            votes.setdefault(x, Counter())[y] += 1
    reading = {x: min(c, key=lambda y: (-c[y], y)) for x, c in votes.items()}
    held = {(s, w, real) for s, w, real, slots in rows if all(reading[x] == y for x, y in slots)}
    share = len({p for s, w, _ in held for p in range(s, s + w)}) / n
    return (len(held), len({r[:3] for r in rows} - held), share) if rows and share >= coverage else None


def swapped(text, r):
    """A text with other numbers and names, each value replaced alike throughout."""
    new = {}
    def other(word):
        core = re.sub(r"^[\W_]+|[\W_]+$", "", word)
        if re.fullmatch(r"[\d]+", core):
            return word.replace(core, new.setdefault(core, str(r.randrange(2, 999))))
        if core[:1].isupper() and core[1:].islower() and core in ("Alice", "Bob", "Carla", "Dmitri"):
            return word.replace(core, new.setdefault(core, r.choice(["Maria", "Ivan", "Wei", "Amara", "Tariq"])))
        return word
    return " ".join(map(other, text.split()))


def made_items(r, n):
    """Questions with numbers, names and units, some of them mostly numbers."""
    words = "sold bought apples pears boxes on friday monday how many did they have left before the shop closed and then again in total each of them paid for it".split()
    out = []
    for k in range(n):
        own = [r.choice(words) for _ in range(r.randint(6, 30))]
        for _ in range(r.randint(0, 12 if k % 3 else 30)):
            own.insert(r.randint(1, len(own)), r.choice([str(r.randrange(2, 99)), str(r.randrange(2, 99)) + " kg", r.choice(["Alice", "Bob", "Carla", "Dmitri"]), "+", "="]))
        out.append("Here " + " ".join(own) + "?")
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(31)
    items = made_items(r, 40) + ["What is it?", "2 + 2", "", "Here", "Compute 1 + 2 - 3 * 4 / 5 + 6"]
    docs = []
    for t in items:
        half = t.split()
        docs += [t, "Before that. " + swapped(t, r) + " and more.", swapped(t, r) + " " + swapped(t, r), " ".join(half[: len(half) * 2 // 3]), " ".join(half[::-1])]
    docs += made_items(r, 20) + [None, "", "a b c " * 500]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    for coverage in (0.5, 0.0):
        want = {(d, i): found for d, x in enumerate(docs) for i, y in enumerate(items) if (found := slow_leak(y, x, coverage))}
        rows = decontaminate.contaminated(frame, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), least_coverage=coverage, block_windows=300).collect()
        assert {(x["doc_id"], x["item_id"]): (x["n_windows"], x["n_inconsistent"], x["coverage"]) for x in rows} == want


def test_recall_on_swapped_numbers_and_names(spark):
    r = random.Random(37)
    items = [t for t in made_items(r, 150) if len(slow_tokens(t)) >= 8]
    docs = [(i, "Some text before. " + swapped(t, r) + " Some text after.") for i, t in enumerate(items)]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sum((i, i) in {(x["doc_id"], x["item_id"]) for x in rows} for i in range(len(items))) >= 0.95 * len(items)


def test_repeated_ids_and_ties_in_leaks(spark):
    a, b = QUESTION, "Another question of quite a few plain words that nobody has ever asked before"
    docs = spark.createDataFrame([(1, a), (1, b), (1, None), (None, a), (2, b), (2, b)], "doc_id long, text string")
    items = spark.createDataFrame([(7, a), (7, b), (None, a), (8, b)], "item_id long, text string")
    rows = decontaminate.contaminated(docs, items).collect()
    assert sorted((x["doc_id"], x["item_id"], x["coverage"]) for x in rows) == [(1, 7, 1.0), (1, 8, 1.0), (2, 7, 1.0), (2, 8, 1.0)]


def test_passages_equal_plain_search(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: " ".join((t or "").lower().split())
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if norm(i["text"]) in norm(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert want and want <= got


def test_pipeline_runs_and_its_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, SF)
        assert after.columns == list(corpus_pipeline.COLUMNS), name
        docs = spark.createDataFrame(after.collect(), after.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before


def test_pipeline_stages_equal_brute_force(spark):
    """What each of the first three stages keeps of the small table, by definition."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    model = quality.fit(quality.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    rows = docs.collect()
    scores = quality.Scorer(model).scores([r["text"] for r in rows])
    kept = stages["quality classifier"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r, x in zip(rows, scores) if x >= 0.5)

    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in rows}
    low = {i: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in own] for i, own in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in low.items()}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    got = stages["SimHash near-dedup"](spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(group.values()))

    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 12):
            first.setdefault(tuple(texts[i][k : k + 13]), i)
    left = {}
    for i, own in texts.items():
        gone = {p for k in range(len(own) - 12) if first[tuple(own[k : k + 13])] < i for p in range(k, k + 13)}
        if not own or len(gone) < len(own):
            left[i] = [w for k, w in enumerate(own) if k not in gone]
    got = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in stages["substring dedup"](spark, docs, SF).collect()}
    assert got == left


def test_pipeline_stages_of_empty_tables(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
