import difflib
import itertools
import random
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import languages, lookalikes, mojibake, repeated_lines, scans
from lexloom.llm.sentences import learn_gaps, sentences, split, words_of_run

ROWS = "field_name string, row_key string, value string"


def cuts(text):
    return [text[b:e] for b, e in split(text)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Dr. Fogeba and Mr. N. Kasusu met in 1980. What remedy has she?", ["Dr. Fogeba and Mr. N. Kasusu met in 1980.", "What remedy has she?"]),
        ("“The levy is void!” argued the clerk. Wait! It rose to 3.54 per cent. of it.", ["“The levy is void!” argued the clerk.", "Wait!", "It rose to 3.54 per cent. of it."]),
        ("The Board replied: “It is late. It cannot be.” and left. (It was so at St. Deziko.) 2. See Art. 43.", ["The Board replied: “It is late. It cannot be.” and left.", "(It was so at St. Deziko.)", "2. See Art. 43."]),
        ("Bags, tools, etc. belong to him at 6 p.m. daily. Scales, etc. The Board sat", ["Bags, tools, etc. belong to him at 6 p.m. daily.", "Scales, etc.", "The Board sat"]),
        ("Notes on tea\n\nIt is so.\nAnd so on.", ["Notes on tea", "It is so.", "And so on."]),
        ("থামুন! ড. সুলেবা ১৯৯২ সালে আসেন। ৬৬। “এই কর বাতিল!” বলিয়া তিনি যান।", ["থামুন!", "ড. সুলেবা ১৯৯২ সালে আসেন।", "৬৬। “এই কর বাতিল!” বলিয়া তিনি যান।"]),
        ("登记员问道：“谁出口了界石？”雇主应当保存。“此项征收无效！”承租人这样主张。", ["登记员问道：“谁出口了界石？”", "雇主应当保存。", "“此项征收无效！”承租人这样主张。"]),
        ("Selon l’art. 55, al. 101, il peut. « Qui a pris ? » a-t-il dit.", ["Selon l’art. 55, al. 101, il peut.", "« Qui a pris ? » a-t-il dit."]),
        ("यह ठीक है। प्रो. खितामो आए। क्यों?", ["यह ठीक है।", "प्रो. खितामो आए।", "क्यों?"]),
        ("", []), (None, []), (" \n ", []), ("no mark at all", ["no mark at all"]),
    ],
)
def test_sentences(text, expected):
    assert (cuts(text) if text else split(text)) == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. !?।。“”()\n\n১(​", max_size=60))
def test_sentences_cover_all_that_is_visible(text):
    spans = split(text)
    assert all(b < e for b, e in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    inside = "".join(text[b:e] for b, e in spans)
    bare = lambda t: "".join(c for c in t if not c.isspace() and c != "​")
    assert bare(inside) == bare(text)


def test_sentence_rows(spark):
    df = spark.createDataFrame([("a", "One. Two.", 1), ("a", "One. Two.", 1), ("b", None, 2), ("c", "", 3), ("d", "x" * 50_000 + ". Next.", 4)], "k string, t string, end_char int")
    rows = sorted((r.record_key, r.sentence_no, r.end_char) for r in sentences(df, "k", "t", "z").collect())
    assert rows == [("a", 1, 4), ("a", 2, 9), ("d", 1, 50_001), ("d", 2, 50_007)]
    assert sentences(df.limit(0), "k", "t", "z").count() == 0
    assert sentences(df.where("k = 'c'"), "k", "t", "z").count() == 0


def test_word_lattice():
    assert words_of_run("承租人这样主张", frozenset(["承租人", "这样主张", "这样"])) == ["承租人", "这样主张"]


def brute_pairs(rows):
    table = str.maketrans(lookalikes.TO_LATIN)
    out = set()
    for (f, a, x), (g, b, y) in itertools.permutations(set(rows), 2):
        if f == g and x is not None and y is not None and x != y and lookalikes.fold(x).translate(table) == lookalikes.fold(y).translate(table) and (int(a) < int(b) if a.isdigit() else a < b):
            out.add((f, a, b))
    return out


def test_look_alike_pairs_match_brute_force(spark):
    base = ["The Café Act, 1999", "সালিশকারী নিবন্ধক", "Paragraph 3 applies to a trustee", "plain words here"]
    change = [lambda t: t, lambda t: t.replace("a", "а"), lambda t: t.replace("e", "е").replace("o", "о"), lambda t: unicodedata.normalize("NFD", t), lambda t: t.replace(" ", " "), lambda t: t[:3] + "​" + t[3:], lambda t: t.replace("The", "Ｔｈｅ"), lambda t: t.upper(), lambda t: t.replace("é", "e")]
    random.seed(1)
    rows = [("f", str(i), random.choice(change)(random.choice(base))) for i in range(60)] + [("f", "900", None), ("f", "901", ""), ("g", "1", base[0]), ("f", "3", "extra")]
    rows += rows[:5]
    got = {tuple(r) for r in lookalikes.look_alike_pairs(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == brute_pairs(rows)
    assert lookalikes.look_alike_pairs(spark.createDataFrame([], ROWS)).count() == 0


def test_visible_differences_stay():
    assert lookalikes.fold("m²") == "m²" and lookalikes.fold("É") == "É" and lookalikes.fold("ﬁsh­") == "fish" and lookalikes.fold(None) is None
    assert "Pension" in lookalikes.proposals("Реnѕіоn")
    assert lookalikes.proposals("plain") == []
    assert lookalikes.proposals("Сrѐche")[0] == "Crèche" and lookalikes.proposals(unicodedata.normalize("NFC", "nο\u0301"))[0] == "nó"


CLEAN = ["আদালত এর ক্ষমতা ও নিবন্ধন", "Pêche, péage et étals du marché", "The owner’s claim – first offence", "Closure of the café “at once”", "कर्मचारी के कर्तव्य"] * 12


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "koi8-r", "cp437", "cp1251", "mac-roman"])
def test_wrong_decoding_round_trip(spark, page):
    good = CLEAN[:5]

    def damage(t):
        return "".join(bytes([b]).decode(page) if _has(b, page) else chr(b) for b in t.encode())

    rows = [("t", i, f"s{i % 3}", t) for i, t in enumerate(CLEAN)] + [("t", 100 + i, "s1", damage(t)) for i, t in enumerate(good)] + [("t", 200, "s0", "lost � text"), ("t", 201, None, None), ("t", 202, None, "")]
    df = spark.createDataFrame(rows + rows[:3], "field_name string, record_id long, source string, value string")
    found = mojibake.records(df)
    assert {r.record_id for r in found.collect()} == {100, 101, 102, 103, 104, 200}
    fixed = {r.record_id: r.value for r in mojibake.restored(df, found).collect()}
    assert sum(fixed[100 + i] == t for i, t in enumerate(good)) >= 4


def _has(b, page):
    try:
        bytes([b]).decode(page)
        return True
    except UnicodeDecodeError:
        return False


def test_decoding_of_nothing(spark):
    empty = spark.createDataFrame([], "field_name string, record_id long, source string, value string")
    assert mojibake.records(empty).count() == 0


def test_languages(spark):
    en = ["The owner of the house shall pay the toll to the Court.", "Is the tenant liable for the loss of it?", "Wait!"]
    fr = ["Le locataire de la maison doit payer le péage dans les huit jours.", "Le préposé est dans la maison avec les registres."]
    bn = ["আদালত এর অনুমতি ব্যতীত কেহ বাগান ইজারা দিবেন না।", "Ei ainer odhine majhi er kache hishab joma dite hobe."]
    rows = [(f"en{i}", " ".join(en)) for i in range(6)] + [(f"fr{i}", " ".join(fr)) for i in range(6)] + [(f"bn{i}", " ".join(bn)) for i in range(6)] + [("mix", f"{en[0]} {fr[0]} {fr[1]} {bn[0]}"), ("none", None), ("blank", " "), ("mix", f"{en[0]} {fr[0]} {fr[1]} {bn[0]}")]
    df = spark.createDataFrame(rows, "k string, t string")
    tagged = languages.sentence_languages(df, "k", "t", languages.fit_models(df, "k", "t"))
    by = {}
    for r in tagged.collect():
        by.setdefault(r.record_key, {})[r.sentence_no] = r.lang
    assert set(by["en0"].values()) == {"en"} and set(by["fr1"].values()) == {"fr"} and set(by["bn2"].values()) == {"bn"}
    assert [by["mix"][i] for i in (1, 2, 3, 4)] == ["en", "fr", "fr", "bn"] and "none" not in by and "blank" not in by
    segments = sorted((r.segment_no, r.lang) for r in languages.segments(tagged).collect() if r.record_key == "mix")
    assert segments == [(1, "en"), (2, "fr"), (3, "bn")]
    owner = tagged.select("record_key").distinct().selectExpr("record_key", "case when record_key = 'mix' then 2 else 1 end as owner_key")
    got = {r.owner_key: r.lang for r in languages.document_languages(tagged, owner).collect()}
    assert got == {1: "mixed", 2: "mixed"}
    assert languages.label_of("bn-BD") == "bn" and languages.label_of(" English ") == "en" and languages.label_of(None) == languages.label_of("und") == ""


def test_penalty_drops_a_language():
    import numpy as np

    scores = np.array([[-50.0, -90, -99, -99, -52, -99], [-40.0, -80, -99, -99, -60, -99], [-10.0, -30, -99, -99, -9.5, -99]])
    assert languages.infer(scores)[0].tolist() == [0, 0, 0]


def brute_lines(results, laws):
    import re

    norm = lambda x: re.sub(r"\s+", " ", re.sub(r"\d+", "0", x.lower())).strip()
    src = dict(laws)
    files, support, occ = {}, {}, []
    for f, law, body, heads, feet in {(a, b, c, tuple(d or ()), tuple(e or ())) for a, b, c, d, e in results}:
        if law not in src:
            continue
        files.setdefault(src[law], set()).add(f)
        for place, items in (("body", body.split("\n") if body is not None else ()), ("header", heads), ("footer", feet)):
            for i, x in enumerate(items, 1):
                if sum(c.isalpha() for c in x) >= 12:
                    support.setdefault((src[law], norm(x)), set()).add(f)
                    occ.append((src[law], norm(x), f, place, i))
    good = {k for k, v in support.items() if len(v) >= 4 and len(v) >= len(files[k[0]]) / 4}
    return {(f, p, i) for s, x, f, p, i in occ if (s, x) in good}


def test_repeated_lines_match_brute_force(spark):
    random.seed(5)
    notice = ["Printed on 01/04/2012 from the shelf", "PRINTED ON 7/4/1999  from the Shelf", "Share this act with a colleague today", "short 1"]
    laws = [(i, f"v{i % 3}") for i in range(40)]
    results = []
    for i in range(40):
        body = "\n".join([random.choice(notice) if random.random() < 0.4 else f"text {chr(97 + i % 26)}{i} of this one here" for _ in range(5)])
        results.append((i, i if i < 38 else None, body if i else None, [random.choice(notice)] if i % 2 else None, []))
    results += results[:3]
    r = spark.createDataFrame(results, "file_id long, law_id long, cleaned_text string, removed_headers array<string>, removed_footers array<string>")
    l = spark.createDataFrame(laws + laws[:2] + [(None, "v0"), (1000, None)], "law_id long, source_pdf string")
    every = repeated_lines.lines(r, l)
    frequent = repeated_lines.frequent_lines(every)
    runs = repeated_lines.prefix_span(every, frequent, gaps=False)
    got = {tuple(x) for x in repeated_lines.occurrences(every, runs).collect()}
    assert got == brute_lines(results, laws) and got
    patterns = repeated_lines.prefix_span(every, frequent).collect()
    singles = {p.pattern[0]: p.support for p in patterns if len(p.pattern) == 1}
    assert all(p.support <= min(singles.get(x, 99) for x in p.pattern) for p in patterns if len(p.pattern) > 1)
    cleaned = {x.file_id: x for x in repeated_lines.without_repeated(every, runs).collect()}
    assert all("from the shelf" not in (x.cleaned_text or "").lower() for x in cleaned.values() if ("v0", 1) and (x.file_id, "body", 1) in got)
    assert repeated_lines.lines(r.limit(0), l).count() == 0


def reader():
    counts = {w: 500 for w in "the inspector shall keep a register of market stalls and tea chests before board প্রদেয় হইবে নিবন্ধন বিষয়ে by-law".split()} | {"rare": 3}
    return scans.Reader(counts, {p: 6.0 for p in scans.CONFUSIONS}, 10)


def test_misread_words():
    r = reader()
    assert r.meant("inspect0r") == "inspector" and r.meant("markct") == "market" and r.meant("register") is None and r.meant("নিবন্ঘন") == "নিবন্ধন" and r.meant("rare") is None and r.meant("") is None


def test_pages(spark):
    page = "The Kirk Salt Pans Act, 1999   12\nThe inspect0r shall keep a reg-\nister of market stalls and by-\nlaw of the Board.\nা ি\n— 12 —"
    rows = [(1, [page, None, ""], ["The Kirk Salt Pans Act, 1999", None]), (2, [], None), (3, None, None), (4, ["shall keep the register."], None)]
    df = spark.createDataFrame(rows, "file_id long, pages array<string>, names array<string>")
    got = {(r.file_id, r.page_no, r.noise) for r in scans.page_noise(df, reader()).collect()}
    assert got == {(1, 1, x) for x in ("running_header", "misread", "broken_word", "stray_marks", "page_number")}
    text = {r.file_id: r.text for r in scans.repaired(df, reader()).collect()}
    assert text[1] == "The inspector shall keep a register of market stalls and by-law of the Board."
    assert scans.page_noise(df.limit(0), reader()).count() == 0


@pytest.mark.parametrize("line, edge, number", [("— 12 —", False, True), ("p. 3 of 9", False, True), ("[৯]", False, True), ("12", True, True), ("12", False, False), ("xxiv", True, True), ("in 1999.", True, False), ("", True, False), ("পৃষ্ঠা ৩", False, True)])
def test_page_numbers(line, edge, number):
    assert scans.numbers_page(line, edge) is number


def test_vocabulary_counts_files(spark):
    df = spark.createDataFrame([(["a b", "b c"],), (["b"],), (None,), ([None],)], "pages array<string>")
    counts, n, _, _ = scans.vocabulary(df, "pages")
    assert n == 3 and counts == {"b": 2}


@pytest.mark.parametrize(
    "lines, mended, noise",
    [
        (["keep the regi ster of stalls"], "keep the register of stalls", {"broken_word": 1}),
        (["keep the regi", "ster of stalls"], "keep the register of stalls", {"broken_word": 1}),
        (["the 1nspect0r shall"], "the inspector shall", {"misread": 1}),
        (["the inspe-", "ct0r shall keep a by-", "law"], "the inspector shall keep a by-law", {"broken_word": 1, "misread": 1}),
        (["of marketstalls and a tea chest"], "of market stalls and a tea chest", {}),
        (["the tea chests shall keep"], "the tea chests shall keep", {}),
    ],
)
def test_cheapest_path_over_the_lines(lines, mended, noise):
    text, found = scans.decode(lines, ["text"] * len(lines), reader())
    assert " ".join(x for x in text if x) == mended and found == noise
    assert scans.decode(lines, ["text"] * len(lines), reader(), rewrite=False)[1] == noise


def test_every_learnt_confusion_has_its_own_cost():
    targets = {f"k{c}word" for c in "abcdefghij"} | {"zebra"}
    got = scans.confusion_costs([("e", "c", 1000), ("k", "x", 10), ("w", "y", 5), ("o", "�", 9), ("1", "2", 9)], targets)
    assert got["k", "x"] == 4.0 and 4.0 < got["w", "y"] < 5.0 and got["e", "c"] == 4.0 and got["s", "5"] == 6.0
    assert ("o", "�") not in got and ("1", "2") not in got


def test_long_paragraphs_stay_whole():
    lines = ["this line runs on and on without an end"] * 150 + ["and ends here."]
    assert scans.paragraphs(lines) == [" ".join(lines)]
    assert scans.paragraphs(["One ends here.", "(1) two goes", "on here.", "(2) three."]) == ["One ends here.", "(1) two goes on here.", "(2) three."]


def test_rare_words_of_many_neighbours_count_in_shares(spark):
    counts = {f"{c}alker": 500 for c in "wtbs"}
    rare = spark.createDataFrame([("xalker",)], "word string")
    got = scans.learn_confusions(counts, rare, 10, support=0.2)
    assert all((c, "x") in got for c in "wtbs")


def test_sentences_of_any_number_of_marks():
    long = "The Board said: “It is " + " or ".join(f"{i}.5" for i in range(100)) + " now.” and left."
    assert cuts(f"{long} Next one.") == [long, "Next one."]
    rates = "The rates (" + ", ".join(f"{i}.5" for i in range(100)) + ") apply to it."
    assert cuts(f"{rates} Next one.") == [rates, "Next one."]


def test_sequences_of_any_length_over_all_places(spark):
    body = [f"line {chr(97 + k) * 14} of the masthead" for k in range(4)]
    results = [(i, i, "\n".join(body), ["the header of this volume"], ["the footer of this volume"]) for i in range(4)]
    r = spark.createDataFrame(results, "file_id long, law_id long, cleaned_text string, removed_headers array<string>, removed_footers array<string>")
    l = spark.createDataFrame([(i, "v") for i in range(4)], "law_id long, source_pdf string")
    every = repeated_lines.lines(r, l)
    found = repeated_lines.prefix_span(every, repeated_lines.frequent_lines(every)).collect()
    assert len(found) == 2**6 - 1 and max(len(p.pattern) for p in found) == 6 and all(p.support == 4 for p in found)


def test_short_sentences_keep_to_their_script(spark):
    en = ["The owner of the house shall pay the toll to the Court.", "Wait!", "Is the tenant liable for the loss of it?"]
    zh = ["承租人应当保存登记册。", "委员会可以处以罚款。"]
    rows = [(f"en{i}", " ".join(en)) for i in range(30)] + [("zh0", "".join(zh)), ("mix", f"{en[0]} {en[1]} {zh[0]}{zh[1]}")]
    df = spark.createDataFrame(rows, "k string, t string")
    kept = languages.sentence_words(df, "k", "t")
    tagged = languages.tagged_sentences(kept, languages.learn_models(kept)).collect()
    assert all(r.lang == "en" and 0 <= r.confidence <= 1 for r in tagged if r.record_key.startswith("en"))
    assert [r.lang for r in sorted(tagged, key=lambda r: r.sentence_no) if r.record_key == "mix"] == ["en", "en", "zh", "zh"]
    nothing = languages.sentence_words(df.limit(0), "k", "t")
    assert languages.tagged_sentences(nothing, languages.learn_models(nothing)).count() == 0


def test_unmet_trigrams_speak_for_no_language(spark):
    rows = [(f"a{i}", "The owner of the house shall pay the toll to the Court.") for i in range(50)] + [("b", "承租人应当保存登记册。")]
    logp = languages.fit_models(spark.createDataFrame(rows, "k string, t string"), "k", "t")
    x = languages.Scorer(logp).read(pd.Series([["qzxv"]]))[0]
    assert abs(x - x[0, 0]).max() < 1e-5


def test_vowels_that_print_as_one_letter():
    assert lookalikes.fold("অাইন") == "আইন" and lookalikes.fold("अाज") == "आज" and lookalikes.fold("अौर") == "और"
    assert all(len(k) == 2 and len(v) == 1 and unicodedata.normalize("NFC", k) == k for k, v in lookalikes.ONE_LETTER.items())


# letters by their names, not by the operator's table
NAMED = {c: unicodedata.lookup(f"CYRILLIC {n}") for c, n in {"a": "SMALL LETTER A", "e": "SMALL LETTER IE", "o": "SMALL LETTER O", "p": "SMALL LETTER ER", "c": "SMALL LETTER ES", "M": "CAPITAL LETTER EM", "T": "CAPITAL LETTER TE"}.items()}


def test_look_alikes_of_every_kind_share_one_form(spark):
    put = lambda t: "".join(NAMED.get(c, c) for c in t)
    base = ["Café of a Map", "Tea Maps Act", "রেশম অাইন", "a", "Map"]
    rows = [("f", f"k{i}", b) for i, b in enumerate(base)]
    rows += [("f", f"k{i}x", put(unicodedata.normalize("NFD", b))) for i, b in enumerate(base[:2])] + [("f", "k2x", "রেশম আইন"), ("f", "k4x", put("Map"))]
    rows += [("f", "r1", "закон о море"), ("f", "r2", "зaкoн о море")]  # a text in Cyrillic letters stays one
    df = spark.createDataFrame(rows, ROWS)
    got = {(r.key_lo, r.key_hi) for r in lookalikes.look_alike_pairs(df, most=1).collect()}
    assert got == {("k0", "k0x"), ("k1", "k1x"), ("k2", "k2x"), ("k4", "k4x"), ("r1", "r2")}
    canon = {r.row_key: r.canon for r in lookalikes.canonical(df).collect()}
    assert canon["k0x"] == base[0] and canon["r2"] == "закон о море"
    classes = {r.row_key: r for r in lookalikes.look_alike_classes(df).collect()}
    assert len(classes) == len(rows) and classes["k0"].class_id == classes["k0x"].class_id and classes["k0"].links == 1 and classes["k3"].links == 0
    assert lookalikes.look_alike_classes(spark.createDataFrame([], ROWS)).count() == 0


NAMES = ["আদালত", "নিবন্ধন", "ক্ষমতা", "কমিশন", "পরিদর্শক", "হাটের", "দোকান", "লবণ", "মাঠ", "বিষয়ে", "নোটিশ", "ইজারাদার", "কর্তৃপক্ষ", "জরিপ", "মানচিত্র", "তহশিলদার", "এর", "ও", "খালের", "কপাট"]


def test_a_page_that_is_not_listed_is_learnt(spark):
    r = random.Random(9)
    text = lambda: " ".join(r.choice(NAMES) for _ in range(5))
    table = {b: chr(0x10A0 + (b - 128) * 37 % 88) if b % 3 else chr(0x1200 + b * 53 % 300) for b in range(128, 256)}
    damage = lambda t: "".join("".join(table[b] for b in c.encode()) if ord(c) > 127 else c for c in t)
    rows = [("t", i, f"s{i % 4}", text()) for i in range(400)]
    wrong = {1000 + i: text() for i in range(80)}
    rows += [("t", i, "s9", damage(t)) for i, t in wrong.items()] + [("t", 2000 + i, "s9", text()) for i in range(20)]
    rows += [("t", 3000 + i, "s8", f"ประเทศ {x} กฎหมาย") for i, x in enumerate(["ไทย", "นี้", "ใหม่"] * 20)]  # a script of its own
    df = spark.createDataFrame(rows, "field_name string, record_id long, source string, value string")
    found = mojibake.records(df)
    ids = {x.record_id for x in found.collect()}
    assert ids <= set(wrong) and len(ids) >= 0.95 * len(wrong)
    fixed = {x.record_id: x.value for x in mojibake.restored(df, found).collect()}
    alike = [difflib.SequenceMatcher(None, fixed[i], wrong[i], autojunk=False).ratio() for i in ids]
    assert sum(alike) > 0.6 * len(alike)  # twenty words are little to learn from; the more frequent letters come first


def test_double_byte_text_read_as_single_bytes(spark):
    good = ["委员会的权力", "受托人的职责", "水表的登记"]
    rows = [("t", i, "s", good[i % 3]) for i in range(30)] + [("t", 100 + i, "s", g.encode("gbk").decode(page, "replace")) for i, (g, page) in enumerate(zip(good, ("latin-1", "mac-roman", "cp1252")))] + [("t", 200, "s", "Œuvre « Pêche, péage et étals ñ’"), ("t", 201, "s", None)]
    df = spark.createDataFrame(rows, "field_name string, record_id long, source string, value string")
    found = mojibake.records(df)
    assert {r.record_id for r in found.collect()} == {100, 101, 102}
    fixed = {r.record_id: r.value for r in mojibake.restored(df, found).collect()}
    assert fixed[100] == good[0] and fixed[101] == good[1]


def test_sequences_without_gaps(spark):
    body = ["first line of the masthead", "second line of the masthead", "third line of the masthead"]
    results = [(i, i, "\n".join([*body[:2], f"text {chr(97 + i) * 9} of this file", body[2]]), [], []) for i in range(4)] + [(4, 4, "\n".join(reversed(body)), None, None)]
    r = spark.createDataFrame(results, "file_id long, law_id long, cleaned_text string, removed_headers array<string>, removed_footers array<string>")
    l = spark.createDataFrame([(i, "v") for i in range(5)], "law_id long, source_pdf string")
    every = repeated_lines.lines(r, l)
    found = repeated_lines.prefix_span(every, repeated_lines.frequent_lines(every), gaps=False).collect()
    assert sorted((len(p.pattern), p.support) for p in found) == [(1, 5)] * 3 + [(2, 4)] * 2 + [(3, 4)]
    assert repeated_lines.prefix_span(every.limit(0), repeated_lines.frequent_lines(every.limit(0)), gaps=False).count() == 0


def test_unmarked_spaceless_text_is_cut_at_learnt_gaps(spark):
    r = random.Random(3)
    who, what, how = ["承租人", "登记员", "委员会", "理事会", "检查员"], ["界石", "水表", "登记册", "渔网", "盐田"], ["应当保存", "不得出口", "可以检查", "必须登记"]
    one = lambda: f"{r.choice(['依照规定', '违反本条'])}{r.choice(who)}{r.choice(how)}{r.choice(what)}{r.choice(['了', '的', '吗'])}"
    df = spark.createDataFrame([("".join(one() + "。" for _ in range(4)),) for _ in range(300)], "unit string")
    gaps = learn_gaps([df])
    assert {"承租人", "委员会", "界石"} <= gaps.words
    right = total = 0
    for _ in range(40):
        parts = [one() for _ in range(5)]
        ends, at = set(), 0
        for p in parts:
            at += len(p)
            ends.add(at)
        got = {e for _, e in split("".join(parts), gaps)}
        right += len(ends & got)
        total += len(ends | got)
    assert right > 0.9 * total
    assert split("关于界石的说明", gaps) == [(0, 7)]
    assert learn_gaps([df.limit(0)]).words


def test_titles_are_parted_once():
    scans._title.cache_clear()
    lines = ["The Ports Act, 1908", "1. Every master of a vessel shall keep a list"]
    for _ in range(3):
        assert scans.furniture([*lines, "x 12 a", "- 12 -"], scans._titles(["The Ports Act, 1908", None])) == ["running_header", "text", "text", "page_number"]
    assert scans._title.cache_info().misses <= 3


def test_lines_longer_than_any_title_are_not_parted():
    scans._title.cache_clear()
    titles = scans._titles(["The Ports Act, 1908", "বন্দর আইন, ১৯০৮"])
    before = scans._title.cache_info().misses
    long = "every master of a vessel shall keep a list and show it"
    assert scans.furniture([long, "The Ports Act, 1908 12", "the Pcrts Act", "বন্দর আইন, ১৯০৮", long], titles) == ["text", "running_header", "running_header", "running_header", "text"]
    assert scans._title.cache_info().misses == before + 2  # one form was met as a title


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("the Inspect0r inspector regi ster reg- ister- by- law 1nspect0r marketstalls tea-chest Xq zzq 12 登记 প্রদেয় নিবন্ঘন হই বে — -".split()), min_size=1, max_size=6), max_size=5), st.sampled_from([" ", ", ", "  "]))
def test_noise_of_a_page_is_what_its_lattice_finds(lines, blank):
    text, r = [blank.join(x) for x in lines], reader()
    assert scans.suffers(text, r) == set(scans.decode(text, ["text"] * len(text), r, rewrite=False)[1])


def test_pages_with_nothing_to_join_take_no_lattice(monkeypatch):
    monkeypatch.setattr(scans, "decode", None)
    r = reader()
    assert scans.suffers(["the inspect0r, shall keep", "a register of Qazxsw"], r) == {"misread"}
    assert scans.suffers(["the board shall keep"], r) == scans.suffers([], r) == set()


@settings(max_examples=200, deadline=None)
@given(st.text("inspectormk015crnি াব", min_size=1, max_size=10))
def test_repairs_are_all_that_make_a_common_word(word):
    r = reader()
    every = [(word[:i] + right + word[i + k :], cost) for i in range(len(word)) for k in (1, 2) for right, cost in r.swaps.get(word[i : i + k], ()) if i + k <= len(word)]
    every += [(word[:i] + right + word[i:], cost) for right, cost in r.gaps if ord(right) >> 7 == ord(word[0]) >> 7 for i in range(1, len(word) + 1)]
    assert list(r.repairs(word)) == [x for x in every if x[0] in r.misread]


def test_pairs_of_all_sources_at_once():
    by_source = {"a": mojibake.Counter({"Ã©tÃ©": 2, "xé": 1, "éÃ": 3}), "": mojibake.Counter(), "b": mojibake.Counter({"Ã©tÃ©": 1})}
    want = {}
    for source, words in by_source.items():
        for what, apart in (("odd", 1), ("odd-3", 3)):
            for a, b, n in mojibake._pairs(words, False, apart):
                if not (a.isascii() and b.isascii()) if apart == 1 else not (a.isascii() or b.isascii()):
                    want[what, source, a, b] = n
    got = pd.concat(mojibake._odd_pairs(by_source))
    assert {(r.what, r.source, r.a, r.b): r.n for r in got.itertuples()} == want and len(got) == len(want)
    assert list(mojibake._odd_pairs({"a": mojibake.Counter()})) == []


def test_bytes_of_words():
    words = mojibake.Counter({"登记abc": 2, "café": 3, "আইন": 1, "x": 5, "\ud800": 1})
    sums = {}
    mojibake._count_bytes(words, sums)
    for what, page in (("utf8", "utf-8"), ("legacy", "cp1252"), ("double", "gbk")):
        want = mojibake.Counter()
        for w, n in words.items():
            raw = w.encode(page, "ignore")
            if what == "double" and "登" not in w or what == "legacy" and len(raw) < len(w):
                continue
            line = b" " + raw + b" "
            for a, b in zip(line, line[1:]):
                want[a * 256 + b] += n
        assert {int(i): int(sums[what][i]) for i in sums[what].nonzero()[0]} == want
    assert sums["utf8-3"][ord("\xe7") * 256 + "登记".encode()[3]] == 2


def test_tokens_are_parted_by_ascii_blanks_only():
    assert [w for w in mojibake.tokens(" a\t\tb\xa0c\n d \x0b\x0ce\r\n") if w] == ["a", "b\xa0c", " d", "e"]
    assert list(map(mojibake._Odd().__getitem__, ["abc", "what??", "a???", "Ã©t", "আইন"])) == [False, False, True, True, False]
