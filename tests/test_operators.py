import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.config import Config
from lexloom.operators import answers, chunking, cleaning, embedding, intent, retrieval, state, structure
from lexloom.plans import pipeline
from lexloom.sources import files, requests
from lexloom.sources.store import PointStore


def test_sections_of_both_scripts():
    assert len(structure.parse("প্রথম\n১। শিরোনাম এক।\n২। শিরোনাম দুই।")[1]) == 2
    assert [s.number for s in structure.parse("Article 1. One.\nArticle 2. Two.")[1]] == ["1", "2"]
    assert structure.parse("plain prose without marks") == ("", [])
    assert structure.parse(None) == ("", [])
    assert structure.parse("")[1] == []


def test_clauses():
    section = structure.parse("১। মূল (১) প্রথম দফা (২) দ্বিতীয় দফা")[1][0]
    assert [c.ident for c in section.clauses if c.parent is None] == ["১", "২"]
    idents = [c.ident for c in structure.clauses_of("(১) এক (review) দুই (২) তিন")]
    assert idents == ["১", "২"]
    kept = structure.clauses_of("(১) এক (ক) দুই (খ) তিন (২) চার")
    assert [(c.ident, c.level, c.parent) for c in kept] == [("১", 1, None), ("ক", 2, 0), ("খ", 2, 0), ("২", 1, None)]
    old = structure.clauses_of("(১) এক (ক) দুই (খ) তিন (২) চার", lossless=False)
    assert [(c.ident, c.level, c.parent) for c in old] == [("১", 1, None), ("ক", 2, 0), ("খ", 3, 1), ("২", 1, None)]


def test_inserted_section_and_article():
    s = structure.parse("৩। উক্ত Order এর Article 8 এর পর নূতন ধারা ৩৭ক সন্নিবেশিত হইবে।")[1][0]
    assert s.inserted == "৩৭ক" and s.article == "8"


def cite(spark, name, hierarchy, title=None, inserted=None):
    keys = ("part", "chapter", "article", "section", "clause", "sub_clause")
    h = F.struct(*[F.lit(hierarchy.get(k, "")).alias(k) for k in keys])
    return spark.range(1).select(chunking.citation(F.lit(name).cast("string"), h, F.lit(title).cast("string"), F.lit(inserted).cast("string")).alias("c")).first()["c"]


def test_citations(spark):
    assert "Section 5" in cite(spark, "The Act", {"section": "5"})
    full = cite(spark, "The Act", {"part": "II", "chapter": "III", "article": "90E", "section": "35", "clause": "2", "sub_clause": "aa"})
    assert full == "The Act, Part II, Chapter III, Article 90E, Section 35, Clause (2), Sub-clause (aa)"
    assert "inserted Section 37A" in cite(spark, "The Act", {"section": "2"}, None, "37A")
    assert "Section " not in cite(spark, "The Act", {})
    assert cite(spark, None, {"section": "1"}) == "" and cite(spark, "", {}) == ""


@pytest.mark.parametrize(
    "changes, valid",
    [({}, True), ({"text": ""}, False), ({"text": "ab"}, False), ({"year": 0}, False), ({"year": None}, False), ({"cited": ""}, False), ({"cited": "", "kind": "preamble"}, True), ({"text": None}, False), ({"text": ") starts inside of it, sadly"}, False)],
)
def test_validation(spark, changes, valid):
    row = {"text": "The inspector shall keep a register.", "kind": "section", "name": "The Act", "year": 2001, "section": "1", "clause": "", "cited": "The Act, Section 1"} | changes
    df = spark.createDataFrame([tuple(row.values())], "text string, kind string, name string, year int, section string, clause string, cited string")
    errors = df.select(chunking.validation_errors(*[F.col(c) for c in row]).alias("e")).first()["e"]
    assert (errors == []) is valid


def test_greedy_groups_match_a_loop(spark):
    random.seed(3)
    lists = [[random.randint(1, 1500) for _ in range(random.randint(0, 30))] for _ in range(40)]
    df = spark.createDataFrame([(x,) for x in lists], "s array<int>")
    for got, sizes in zip([r.g for r in df.select(chunking.greedy_groups(F.col("s"), 1000).alias("g")).collect()], lists):
        expected, group, filled = [], 0, 0
        for x in sizes:
            if filled + x > 1000 and filled:
                group, filled = group + 1, 0
            filled += x
            expected.append(group)
        assert got == expected


def test_pieces_keep_the_budget_and_the_text():
    body = "১। " + " ".join(f"বাক্য নম্বর {i} এখানে আছে।" for i in range(400))
    out = chunking.pieces(body, 200)
    assert len(out) > 5 and all(sum(map(chunking._tokens, chunking._sentences(p[1]))) <= 200 for p in out)
    assert re.sub(r"\s", "", "".join(p[1] for p in out)) == re.sub(r"\s", "", body)
    assert chunking.pieces("no marks here at all", lossless=False) == [] and len(chunking.pieces("no marks here at all")) == 1
    assert chunking.pieces(None) == []


def naive_clean(pages):
    heads = {}
    for p in pages:
        for x in {y.strip() for y in p.split("\n")[:8] if len(y.strip()) >= 3}:
            heads[x] = heads.get(x, 0) + 1
    limit = max(2, int(len(pages) * 0.6))
    return {x for x, n in heads.items() if n >= limit}


def test_cleaning(spark):
    fill = ["\n".join(f"line {p}{i} of its own text" for i in range(6)) for p in "abc"]
    pages = [f"The Act\n{fill[0]}\n1 / 3", f"The Act\nsecond line of amend-\nment\n{fill[1]}\n2 / 3\nbdlaws.minlaw.gov.bd/x", f"The Act\n04/07/2026\nthird\nা ি\n{fill[2]}\n3 / 3"]
    df = spark.createDataFrame([(1, pages), (2, []), (3, None), (4, [None, "only"])], "id int, pages array<string>")
    rows = {r.id: r for r in cleaning.clean(df, "pages").collect()}
    assert set(rows[1].removed_headers) == naive_clean(pages) == {"The Act"}
    assert rows[1].cleaned_text == f"The Act\n{fill[0]}\nsecond line of amendment\n{fill[1]}\nthird\n{fill[2]}"
    assert rows[1].removed_noise_count == 1 and rows[1].source_pages == 3 and "1 / 3" in rows[1].removed_footers
    assert rows[2].cleaned_text == "" and rows[3].source_pages == 0 and rows[4].cleaned_text == "only"


@pytest.mark.parametrize(
    "question, kind",
    [("Show me Article 90E", "law_search"), ("Summarize the Penal Code", "act_summary"), ("What changed in the Amendment Act?", "amendment_question"), ("My landlord has evicted me illegally", "fact_analysis"), ("What is the punishment for theft?", "legal_question")],
)
def test_question_types(spark, question, kind):
    row = intent.classify(spark.createDataFrame([(question,)], "question string")).first()
    assert row.query_type == kind and row.routed_agent == intent.ROUTES.get(kind, intent.DEFAULT_ROUTE)


def test_domains_and_presets(spark):
    df = spark.createDataFrame([("punishment for murder", "act_summary"), ("nomination rules", ""), ("government service rules", None), (None, None)], "question string, query_type string")
    rows = intent.classify(df).collect()
    assert [r.legal_domain for r in rows] == ["criminal", "election", "employment", "general"]
    assert [r.query_type for r in rows] == ["act_summary", "legal_question", "legal_question", "legal_question"] and rows[0].top_k == 20
    assert spark.range(1).select(intent.question_type(F.lit("random text"), F.lit(0)).alias("t")).first().t == "no_results"


def points(spark):
    return spark.createDataFrame([(i, [1.0, float(i)], "en" if i % 2 else "bn") for i in range(6)] + [(9, [0.0, 0.0], "en")], "vec_id long, embedding array<double>, lang string")


def test_top_k_is_exact(spark):
    got = retrieval.top_k(points(spark), [1.0, 2.0], k=3).collect()
    assert [r.vec_id for r in got] == [2, 3, 4] and [r["rank"] for r in got] == [1, 2, 3] and got[0].score == 1.0
    q = spark.createDataFrame([(1, [1.0, 2.0], 2), (2, [1.0, 0.0], 1)], "qid int, query_vector array<double>, n int")
    many = retrieval.top_k_batch(points(spark), q, k="n").orderBy("qid", "rank").collect()
    assert [(r.qid, r.vec_id) for r in many] == [(1, 2), (1, 3), (2, 0)]


def test_blocks_of_queries_agree(spark, monkeypatch):
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "qid int, query_vector array<double>")
    whole = sorted(map(tuple, retrieval.top_k_batch(points(spark), q, k=2).select("qid", "vec_id", "rank").collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    assert sorted(map(tuple, retrieval.top_k_batch(points(spark), q, k=2).select("qid", "vec_id", "rank").collect())) == whole


def chunks(spark):
    h = "struct<article:string,section:string,clause:string,sub_clause:string>"
    rows = [(1, 1, "c1", "The Act, Section 1", 0.85, "text one", ("", "1", "", ""), "The Act", [("act", "x"), ("act", "x")]), (1, 2, "c2", "", 0.5, "text two", ("", "379", "", ""), "The Act", [("article", "y")]), (1, 3, "c3", "The Act, Section 1", 0.4, None, ("", "1", "", ""), "The Act", None)]
    return spark.createDataFrame(rows, f"qid int, rank int, chunk_id string, citation string, score double, text string, hierarchy {h}, act_name string, law_refs array<struct<ref_type:string,target:string>>")


def test_answers(spark):
    c = chunks(spark)
    assert answers.citations(c, "qid").first().citations == ["The Act, Section 1", "The Act, Section 379"]
    assert [tuple(r) for r in answers.references(c, "qid").first().references] == [("act", "x"), ("article", "y")]
    row = answers.contexts(c, "qid", 2).first()
    assert row.context.startswith("[Chunk 1] | The Act, Section 1 | relevance=0.85\ntext one\n\n---\n\n[Chunk 2]") and row.retrieved == 3 and "Chunk 3" not in row.context


def test_providers_fail_over(spark):
    def broken(prompt, question):
        raise RuntimeError("down")

    df = spark.createDataFrame([("[Chunk 1]\nFirst. Second.", "q", "en")], "prompt string, question string, language string")
    assert answers.answer(df, [broken, answers.extractive]).first().answer == "First."
    row = answers.answer(df, [broken]).first()
    assert row.error == "down" and row.answer.startswith("An error")


def test_state(spark):
    log = spark.createDataFrame([("a", "failed", 0, "e" * 600, 1), ("a", "done", 5, None, 2), ("b", "failed", 0, "x", 1), ("b", "failed", 0, "x", 1), ("c", "pending", 0, None, None)], "filepath string, status string, chunks_count int, error_text string, processed_at int")
    now = state.latest(log)
    assert {r.filepath: r.status for r in now.collect()} == {"a": "done", "b": "failed", "c": "pending"}
    assert {r.status: r.n for r in state.summary(now).collect()} == {"done": 1, "failed": 1, "pending": 1}
    assert [r.filepath for r in state.unprocessed(now.select("filepath"), now).orderBy("filepath").collect()] == ["b", "c"]
    assert tuple(state.rollup(now).first()) == (3, 1, 1, 5)
    assert state.pending(state.retry_failed(now)).count() == 2
    empty = log.limit(0)
    assert state.latest(empty).count() == 0 and tuple(state.rollup(empty).first()) == (0, 0, 0, 0)


def test_requests(spark):
    df = spark.createDataFrame([('{"question": "What is it?"}',), ('{"question": ""}',), ('{"question": "  a "}',), ("{}",), ('{"question": "ok then", "top_k": 99}',)], "body string")
    got = requests.parse(df, "body", "chat").collect()
    assert [r.error for r in got] == [None, "question: too short", "question: too short", "question: missing", "question: top_k out of range"] and got[0].user_type == "general"


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 0, "x"), ("a", "1", 1, "y"), ("b", "2", 0, "z")], "source string, section string, chunk_index int, text string")
    store = PointStore(spark, str(tmp_path / "points"))
    schema = spark.createDataFrame([], "point_id string, section string, chunk_index int, text string, source string").schema
    store.ensure(schema)
    store.ensure(schema)
    store.upsert(rows)
    store.upsert(rows.where("source = 'a'"))
    assert store.info().first().points_count == 3
    store.delete_source("a")
    assert store.points().count() == 1
    store.truncate()
    assert store.points().count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xff")
    rows = {r.filename: r for r in files.load(spark, str(tmp_path), files.text_pages, "*.txt").collect()}
    assert rows["a.txt"].pages == ["one", "two"] and rows["a.txt"].load_error is None and "decode" in rows["b.txt"].load_error
    assert files.scan(spark, str(tmp_path)).count() == 2


def test_word_processor_files(spark, tmp_path):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "<w:p><w:r><w:t>one</w:t><w:tab/><w:t> line</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t><w:br w:type='page'/><w:t>three</w:t></w:r></w:p><w:p/>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='{w}'><w:body>{body}</w:body></w:document>")
    (tmp_path / "b.txt").write_text("x\fy")
    (tmp_path / "c.docx").write_bytes(b"no archive")
    rows = {r.filename: r for r in files.load(spark, str(tmp_path), files.any_pages(), "*", named=True).collect()}
    assert rows["a.docx"].pages == ["one\t line\ntwo", "three\n"] and rows["b.txt"].pages == ["x", "y"] and rows["c.docx"].load_error


def test_embedding(spark):
    df = spark.createDataFrame([("b", "two words"), ("c", ""), ("d", None)], "k string, t string")
    got = df.select(embedding.hashed("t", 8).alias("v")).collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in got) and got[1].v[0] == 1.0
    calls = []

    def load():
        def model(texts):
            if any(len(t) > 6000 for t in texts):
                raise ValueError("too long")
            return [[3.0, 4.0] for _ in texts]

        return model

    long = spark.createDataFrame([("x" * 7000,), (None,)], "t string")
    assert [list(r.embedding) for r in embedding.embed(long, "t", load).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)]] * 2


def test_pipeline(spark):
    page = "The Salt Act, 1999\nAct No. 3 of 1999\nArticle 1. The inspector shall keep a register of salt pans. Article 2. Every lessee may appeal to the court."
    df = spark.createDataFrame([("act-print-7.pdf", [page], None), ("bad.pdf", [], "empty file")], "filename string, pages array<string>, load_error string")
    made = pipeline.ingest(df).collect()
    assert {r.metadata["act_year"] for r in made} == {1999} and all(r.metadata["source_pdf"] == "act-print-7.pdf" for r in made)
    assert sum(r.valid for r in made) >= 2 and any("Section 1" in r.citation for r in made)


def test_config():
    assert Config(store_path="").errors() and Config(store_path="x").errors() == [] and Config(store_path="x", top_k=0).errors()


def test_streaming(spark, tmp_path):
    from lexloom.streaming.ingest import available_now

    rows = spark.createDataFrame([(1, "a")], "id int, t string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        available_now(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "ck"), lambda b: b.withColumn("n", F.length("t")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    available_now(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "ck"), lambda b: b.withColumn("n", F.length("t")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_copies_of_a_point_take_one_place(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])] * 5 + [(2, [1.0, 0.5]), (3, [1.0, 0.6])], "vec_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid int, query_vector array<double>")
    got = retrieval.top_k_batch(rows, q, k=2).orderBy("rank").collect()
    assert [(r.vec_id, r["rank"]) for r in got] == [(1, 1), (2, 2)]


def _points(spark):
    from lexloom.operators.embedding import hashed

    rows = [(f"p{i}", t, "Salt Pans Act" if i % 2 else "Ferry Act", str(i % 3), i != 4) for i, t in enumerate(["toll of the ferry", "salt pans are leased", "ferry owner pays", "the lease of salt pans ends", "ferry toll rises", "boats and carts"])]
    df = spark.createDataFrame(rows, "point_id string, text string, act string, section string, whole boolean")
    empty = F.array().cast("array<struct<ref_type:string,target:string>>")
    hierarchy = F.struct(F.lit("").alias("article"), "section", F.lit("").alias("clause"), F.lit("").alias("sub_clause"))
    return df.select("point_id", "text", F.col("act").alias("act_name"), hierarchy.alias("hierarchy"), F.lit("").alias("citation"), empty.alias("law_refs"), F.struct(F.col("act").alias("act_name")).alias("metadata"), F.create_map(F.lit("is_complete_chunk"), "whole").alias("validation"), hashed("text", 64).alias("embedding"))


TEMPLATES = {("legal_qa", "en"): "{user_type}\n{context}", ("act_summary", "en"): "Summary\n{context}"}


def test_search_takes_filters_and_a_rewriter(spark):
    points = _points(spark)
    ask = spark.createDataFrame([(1, "ferry toll"), (2, "qqq zzz www"), (3, None)], "qid long, question string")
    found = pipeline.search(points, ask, 0.05, 0.01, filters={"act_name": "Ferry", "colour": "red", "validation.is_complete_chunk": True}).collect()
    assert {r.point_id for r in found if r.qid == 1} <= {"p0", "p2"} and any(r.qid == 1 for r in found)
    again = pipeline.search(points, ask.where("qid = 2"), 0.3, 0.2, rewriter=lambda q: "salt pans are leased").collect()
    assert [r.point_id for r in sorted(again, key=lambda r: r["rank"])][0] == "p1"
    assert pipeline.search(points.limit(0), ask).count() == 0


def test_one_pass_serves_both_thresholds(spark):
    ranked = spark.createDataFrame([(1, 0.5, 1), (1, 0.2, 2), (2, 0.2, 1), (2, 0.16, 2)], "qid long, score double, rank int")
    assert sorted((r.qid, r.score) for r in retrieval.first_or_relaxed(ranked, 0.3).collect()) == [(1, 0.5), (2, 0.16), (2, 0.2)]


def test_an_empty_context_is_not_asked_about(spark):
    asked = []

    def provider(prompt, question):
        if "ferry" not in prompt:
            raise AssertionError(prompt)
        return "found", 1, 1

    ask = spark.createDataFrame([(1, "ferry toll", "en"), (2, "qqq zzz", "en"), (3, "qqq", "bn")], "qid long, question string, language string")
    got = {r.qid: r for r in pipeline.chat(_points(spark), ask, TEMPLATES, (provider,), threshold=0.3, relaxed=0.25).collect()}
    assert got[1].answer == "found" and not asked
    assert got[2].answer == answers.NOT_FOUND["en"] and got[3].answer == answers.NOT_FOUND["bn"] and got[2].confidence == "low" and got[2].prompt_tokens == 0


def test_flows_by_type_act_and_section(spark):
    points = _points(spark)
    facts = spark.createDataFrame([(1, "the ferry owner pays no toll")], "qid long, question string")
    assert pipeline.analyze(points, facts, TEMPLATES, threshold=0.05).first().routed_agent == "legal_analysis_agent"
    made = pipeline.summarize(points, "Salt Pans Act", TEMPLATES, threshold=0.01, relaxed=0.001).first()
    assert made.routed_agent == "act_summary_agent" and "ferry" not in made.answer.lower()
    vector = list(points.where("point_id = 'p1'").first().embedding)
    assert {r.point_id for r in retrieval.by_act(points, "Salt", vector, threshold=1e-9, point_id="point_id").collect()} <= {"p1", "p3", "p5"}
    assert [r.point_id for r in retrieval.by_section(points, "1", vector, "Salt", threshold=1e-9, point_id="point_id").collect()] == ["p1"]


def test_keyword_scores_match_a_plain_loop(spark):
    import math
    import random
    import re

    r = random.Random(4)
    docs = [(i, " ".join(r.choice("salt ferry toll lease boat court of the".split()) for _ in range(r.randint(0, 30)))) for i in range(80)] + [(900, None), (901, "")]
    asks = [(1, "ferry toll"), (2, "court COURT salt"), (3, "nothing here"), (4, None)]
    held = [(i, re.findall(r"\w+", t.lower())) for i, t in docs if t is not None]
    mean = sum(len(w) for _, w in held) / len(held)
    expected = set()
    for q, text in asks:
        scores = []
        for i, words in held:
            total = 0
            for w in set(re.findall(r"\w+", (text or "").lower())):
                df = sum(w in x for _, x in held)
                tf = words.count(w)
                total += round(math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean)) * 1e6)
            if total:
                scores.append((-total, i))
        expected |= {(q, i) for _, i in sorted(scores)[:5]}
    D, Q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asks, "qid long, query string")
    got = {(x.qid, x.doc_id) for x in retrieval.keyword_top_k(D, Q, "doc_id", "text", 5).collect()}
    assert got == expected
    assert retrieval.keyword_top_k(D, Q.limit(0), "doc_id", "text", 5).count() == 0 and retrieval.keyword_top_k(D.limit(0), Q, "doc_id", "text", 5).count() == 0
