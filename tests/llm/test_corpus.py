import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from lexloom.llm import abuse, leaks, packing


def test_plan_places_every_item_and_fills_well():
    random.seed(2)
    for capacity in (10, 64, 256):
        histogram = {s: random.randint(0, 40) for s in range(1, capacity + 1)}
        plan = packing.plan(histogram, capacity)
        used = {}
        for combination, times in plan:
            assert sum(s * n for s, n in combination.items()) <= capacity and times > 0
            for s, n in combination.items():
                used[s] = used.get(s, 0) + n * times
        assert used == {s: n for s, n in histogram.items() if n}
        bins, total = sum(t for _, t in plan), sum(s * n for s, n in histogram.items())
        assert bins <= -(-total // capacity) * 1.15 + 1  # half of these items exceed half a container
    assert packing.plan({}, 5) == []


def test_fullest_is_optimal():
    random.seed(4)
    for _ in range(200):
        counts = {random.randint(1, 12): random.randint(1, 3) for _ in range(random.randint(0, 5))}
        room = random.randint(0, 30)
        reach = {0}
        for s, n in counts.items():
            reach = {a + s * k for a in reach for k in range(n + 1) if a + s * k <= room}
        used = packing._fullest(room, sorted(counts, reverse=True), counts)
        assert sum(s * n for s, n in used.items()) == max(reach) and all(n <= counts[s] for s, n in used.items())


def test_pack(spark):
    random.seed(3)
    rows = [(i, random.choice([5, 5, 5, random.randint(0, 60)])) for i in range(300)] + [(900, 0), (901, 175), (902, 64), (903, None)]
    items = spark.createDataFrame(rows, "item long, tokens long")
    got = packing.pack(items, "k", 64).toPandas()
    assert got.groupby("item")["tokens"].sum().to_dict() == {i: t for i, t in rows if t is not None}
    filled = got.dropna(subset=["container_no"]).groupby("container_no")["tokens"].sum()
    assert filled.max() <= 64 and len(filled) <= -(-sum(t or 0 for _, t in rows) // 64) + 2
    assert sorted(got[got["item"] == 901]["tokens"]) == [47, 64, 64] and got[got["item"] == 902].shape[0] == 1 and got[got["item"] == 900]["container_no"].isna().all()
    assert sorted(filled.index) == list(range(1, len(filled) + 1))
    assert packing.pack(items.limit(0), "k", 64).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items, "k", 0)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "two words", 1), (1, "two words", 1), (2, None, 1), (3, "", 1), (4, "<|endoftext|>", 1)], "doc_id long, text string, tokens int")
    got = {r.item: r.tokens for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert got[2] == got[3] == 0 and got[1] >= 2 and got[4] > 1


def words_of(n, seed):
    r = random.Random(seed)
    return [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randint(0, 999)}" for _ in range(n)]


def test_leaks_match_brute_force(spark):
    items = [(i, " ".join(words_of(40, i))) for i in range(20)] + [(50, "too short"), (51, None)]
    docs = []
    for d in range(120):
        body = words_of(60, 1000 + d)
        if d % 3 == 0:
            source, n = items[d % 20][1].split(), 10 + d % 6
            body[20:20] = [w.upper() + "," for w in source[5 : 5 + n]] if d % 2 else source[5 : 5 + n]
        docs.append((d, " ".join(body) if d % 5 == 0 else "  ".join(body)))
    docs += docs[:4] + [(500, None), (501, ""), (502, "one two")]
    expected = set()
    for d, t in docs:
        plain = [w.strip(",").lower() for w in (t or "").split()]
        grams = {tuple(plain[i : i + 12]) for i in range(len(plain) - 11)}
        for i, it in items:
            w = (it or "").split()
            if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                expected.add((d, i))
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leaks.leaks(D, "doc_id", "text", I, "item_id", "text").collect()}
    assert got == expected and expected
    assert leaks.leaks(D.limit(0), "doc_id", "text", I, "item_id", "text").count() == 0
    assert leaks.leaks(D, "doc_id", "text", I.limit(0), "item_id", "text").count() == 0


def test_leaks_with_edits_reach_the_recall(spark):
    items = [(i, " ".join(words_of(12, i))) for i in range(60)]
    docs = []
    for i, t in items:
        w = t.split()
        w[3 + i % 6] = "changed"
        docs.append((i, " ".join(words_of(15, 700 + i) + w + words_of(15, 900 + i))))
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", edits=1, recall=0.95).collect()
    assert sum(r.doc_id == r.item_id for r in got) >= 54 and all(r.doc_id == r.item_id for r in got)


def test_gradients_match_differences():
    net = abuse.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    bags = [abuse.slots(w) for w in "one two three four five".split()]
    r = np.random.default_rng(0)
    index = r.integers(0, 5, (3, 6))
    mask = np.ones((3, 6))
    mask[1, 4:] = 0
    y, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)
    g = net.gradients(index, mask, y, weight, bags)

    def loss():
        p = net.run(net.project(bags)[index], mask)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for name, place in [("Uf", (0, 1)), ("Ub", (2, 30)), ("Wf", (1, 2)), ("cb", (5,)), ("wa", (3,)), ("wo", (4,)), ("bo", (0,)), ("E", (bags[0][0], 2))]:
        old, eps = net.p[name][place], 1e-4
        net.p[name][place] = old + eps
        up = loss()
        net.p[name][place] = old - eps
        down = loss()
        net.p[name][place] = old
        assert abs((up - down) / (2 * eps) - g[name][place]) < 2e-3


def test_spelling_tricks():
    norm = lambda t: [abuse.normal(w) for w in abuse.words(t)]
    assert norm("m0r0n") == norm("moron") == norm("M o r o n") == norm("m.o.r.o.n") == norm("m-o-r-o-n") == norm("morooon")
    assert norm("") == [] and abuse.windows(0) == [] and abuse.windows(abuse.WINDOW + 1) == [0, 1]


def corpus(seed, n):
    r = random.Random(seed)
    plain = "the inspector shall keep a register of market stalls and produce it to the board within days every lessee may appeal against orders of court".split()
    bad = ["you worthless moron go drown yourself", "shut up you filthy pig", "burn their houses every one of them"]
    texts, y = [], []
    for i in range(n):
        body = [r.choice(plain) for _ in range(60)]
        y.append(float(i % 4 == 0))
        if y[-1]:
            at = r.randint(0, 59)
            body[at:at] = r.choice(bad).split()
        texts.append(" ".join(body))
    return texts, np.array(y)


def test_training_reaches_held_out_accuracy(spark):
    texts, y = corpus(1, 400)
    noisy = y.copy()
    noisy[::25] = 1 - noisy[::25]  # reviewers err
    net, threshold = abuse.train(texts, noisy)
    held, truth = corpus(2, 200)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(held)] + [(900, None, "s", 1), (901, "", None, 1)], "doc_id long, text string, source string, score int")
    got = {r.doc_id: r.score for r in abuse.scores(df.drop("score"), net, ["source"]).collect()}
    assert got[900] == got[901] == 0.0 and len(got) == 202
    accuracy = np.mean([(got[i] >= threshold) == bool(t) for i, t in enumerate(truth)])
    assert accuracy >= 0.95


def test_training_without_labels():
    net, threshold = abuse.train([], np.array([]))
    assert 0 < threshold <= 1
    net, _ = abuse.train(["a b c"], np.array([0.0]))
    assert net.p["bo"][0] < 0


def test_reviewers_are_weighed():
    rows = [(d, f"r{k}", int(d % 3 == 0)) for d in range(60) for k in (1, 2)] + [(d, "liar", int(d % 3 != 0)) for d in range(60)]
    got = abuse.verdicts(pd.DataFrame(rows, columns=["doc_id", "reviewer", "verdict"]))
    assert all((p > 0.5) == (d % 3 == 0) for d, p in got.items())
    assert abuse.verdicts(pd.DataFrame(columns=["doc_id", "reviewer", "verdict"])) == {}


def test_every_span_stands_whole_in_a_window():
    most = abuse.WINDOW - abuse.STRIDE + 1
    for n in (1, 24, 25, 40, 97):
        starts = abuse.windows(n)
        for length in range(1, min(17, n) + 1):
            assert all(any(w <= s and s + length <= w + abuse.WINDOW for w in starts) for s in range(n - length + 1)), (n, length)
    assert most == 17


def test_pieces_of_two_three_and_four_letters():
    whole = set(abuse.slots("abcde"))
    assert {zlib.crc32(p.encode()) % abuse.BUCKETS for p in ("<a", "ab", "abc", "abcd", "cde>", "<abcde>")} <= whole


def test_read_gives_what_run_gives():
    rng = np.random.default_rng(5)
    net = abuse.Network(3)
    table = net.project([abuse.slots(f"w{i}") for i in range(50)])
    index = rng.integers(0, 50, (70, abuse.WINDOW))
    index[40:] = index[:30]
    mask = np.ones(index.shape, np.float32)
    mask[5, 3:] = mask[45, 9:] = 0
    assert np.allclose(net.read(*net.halves(table), index, mask), net.run(table[index], mask), atol=1e-5)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_recall_at_edits_against_brute_force(spark, edits):
    r = random.Random(edits)
    items = [(i, " ".join(words_of(12, i))) for i in range(120)]
    docs = []
    for i, t in items:
        w = t.split()
        for k in range(edits):
            place = r.randrange(len(w))
            if k % 3 == 0:
                w[place] = f"changed{i}x{k}"
            elif k % 3 == 1:
                w.insert(place, f"added{i}x{k}")
            else:
                del w[place]
        docs.append((i, " ".join(words_of(15, 700 + i) + w + words_of(15, 900 + i))))

    def near(doc, item):
        return min(leaks._distance(np.array(doc[b : b + 12 + edits], dtype=object), np.array(item, dtype=object), edits) for b in range(len(doc) - 11)) <= edits

    truth = {(d, i) for d, t in docs for i, x in items if abs(d - i) < 2 and near(t.split(), x.split())}
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(x) for x in leaks.leaks(D, "doc_id", "text", I, "item_id", "text", edits=edits, recall=0.95).collect()}
    assert len(truth) >= 110 and len(got & truth) >= 0.9 * len(truth) and got <= truth
    assert leaks.repetitions(edits, 12, 0.95) < 100


def test_items_in_blocks(spark):
    items = [(i, " ".join(words_of(14, i))) for i in range(30)]
    D = spark.createDataFrame([(i, f"before it {t} and after") for i, t in items], "doc_id long, text string")
    I = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(x) for x in leaks.leaks(D, "doc_id", "text", I, "item_id", "text", block=7).collect()}
    assert got == {(i, i) for i, _ in items}


def test_slots_of_many_words_are_those_of_each():
    some = ["", "a", "abcde", "চোর", "él", "龍", "x" * 40, "𝒳y"]
    flat, size = abuse.slots_of(some)
    at = 0
    for w, n in zip(some, size):
        m = f"<{w}>"
        plain = [zlib.crc32(m.encode()) % abuse.BUCKETS] * 2 + [zlib.crc32(m[i : i + k].encode()) % abuse.BUCKETS for k in (2, 3, 4) for i in range(len(m) - k + 1)]
        assert sorted(flat[at : at + n].tolist()) == sorted(plain)
        at += n
    assert len(abuse.slots_of([])[0]) == 0


def test_words_of_the_table_stand_in_whole_rows_of_each_gate():
    net = abuse.Network(3)
    halves = net.halves(net.project([abuse.slots(f"w{i}") for i in range(50)]))
    assert all(h.shape == (3, 50, abuse.HIDDEN) and h.flags.c_contiguous for h in halves)  # else each step copies the whole table
    net.p["cf"] += 200  # exponentials beyond all bounds
    table = net.project([abuse.slots("w")])
    index, mask = np.zeros((2, abuse.WINDOW), np.int64), np.ones((2, abuse.WINDOW), np.float32)
    assert np.allclose(net.read(*net.halves(table), index, mask), net.run(table[index], mask), atol=1e-5)


def test_words_are_what_no_blank_or_mark_parts():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice("ab xyz.,;:?()[]{}“”\"«»।॥…—–/。，！\n  é-_ক") for _ in range(30))
        apart = re.findall("[^\\s" + re.escape(abuse._BETWEEN) + "]+", text)
        if not re.search(r"(?<!\w)\w(?:\W+\w(?!\w)){3}", text):  # letters spread one by one are put together
            assert abuse.words(text) == apart


def test_short_windows_are_read_apart(monkeypatch):
    net, data = abuse.Network(3), abuse.Data()
    cuts = [data.cut(t) for t in (" ".join(f"w{i % 7}" for i in range(n)) for n in (30, 3, 80, 24, 1, 50))]
    index, mask = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
    seen, read = [], net.read
    monkeypatch.setattr(abuse, "BATCH", 4)
    monkeypatch.setattr(net, "read", lambda f, b, i, m: seen.append(bool(m.all())) or read(f, b, i, m))
    assert np.allclose(abuse.probabilities(net, data, index, mask), net.run(net.project(data.bags)[index], mask), atol=1e-5)
    assert seen == sorted(seen, reverse=True) and seen.count(False) == 1
