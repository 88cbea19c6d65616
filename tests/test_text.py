import pytest
from pyspark.sql import functions as F

from lexloom.functions import extract, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "mark, genuine",
    [("১", True), ("১২", True), ("১২৩৪", False), ("1", True), ("10", True), ("1000", False), ("ক", True), ("গ", True), ("a", True), ("ii", True), ("aa", True), ("xial", True), ("xiaa", True),
     ("review", False), ("Amendment", False), ("GEMS", False), ("PMIS", False), ("except", False), ("xxxxx", False), ("A", False), ("BBB", False), ("I", False)],
)
def test_clause_identifiers(spark, mark, genuine):
    from lexloom.operators.structure import is_clause_identifier

    assert one(spark, text.is_clause_identifier, mark) is genuine
    assert is_clause_identifier(mark) is genuine


def test_language(spark):
    assert one(spark, text.query_language, "ধারা ৯০ কী বলে?") == "bn"
    assert one(spark, text.query_language, "What is the punishment?") == "en"
    assert one(spark, text.query_language, "123 ?!") == "en"
    assert one(spark, text.query_language, "আইনে nomination এর নিয়ম কী") == "bn"
    assert one(spark, text.document_language, "Act of ১") == "mixed" or one(spark, text.document_language, "Act of ১") == "en"


def test_noise_lines(spark):
    assert one(spark, text.is_noise_line, "া ি") is True
    assert one(spark, text.is_noise_line, "") is False
    assert one(spark, text.is_noise_line, "আইন সংশোধন") is False


def test_spaces_and_hyphens(spark):
    assert one(spark, text.collapse_whitespace, "  a \t b \n\n\n\n c\n  d ") == "a b\n\nc\nd"
    assert one(spark, text.dehyphenate, "amend-\nment and আই-\nন") == "amendment and আইন"
    assert one(spark, text.estimate_tokens, "abcdefgh") == 2
    assert one(spark, text.footer_page, " ১ / ৪ ") == 1
    assert one(spark, text.footer_page, "0/4") is None
    assert one(spark, text.bengali_to_int, "২০২৬") == 2026
    assert one(spark, text.bengali_to_int, "x") == 0


def test_nulls_stay_null(spark):
    for f in (text.collapse_whitespace, text.dehyphenate, text.normalize_unicode, text.strip, text.estimate_tokens):
        assert one(spark, f, None) is None


def test_metadata(spark):
    page = "সরকারি চাকরি (সংশোধন) আইন, ২০২৬\n( ২০২৬ সনের ০১ নং আইন )\n[ ০৫ এপ্রিল, ২০২৬ ]\nসরকারি চাকরি আইন, ২০১৮ (২০১৮ সনের ৫৭ নং আইন) সংশোধনকল্পে প্রণীত আইন"
    df = spark.createDataFrame([(page, page, "act-print-1630.pdf")], "body string, first string, file string")
    row = extract.metadata(df, "body", "first", "file").first()
    assert (row.act_year, row.act_number, row.publication_date, row.volume) == (2026, "1", "০৫ এপ্রিল, ২০২৬", "1630")
    assert row.bangla_name == "সরকারি চাকরি (সংশোধন) আইন, ২০২৬" and row.document_type == "Amendment Act" and row.language == "bn"
    assert row.amendment_of == "সরকারি চাকরি আইন, ২০১৮ (২০১৮ সনের ৫৭ নং আইন)"
    assert [tuple(r) for r in row.law_refs] == [("act", "2026 সনের 1 নং আইন"), ("act", "2018 সনের 57 নং আইন")]


def test_references_keep_order_and_first(spark):
    got = one(spark, extract.references, "Section 5 and Article 90E, President's Order No. 155 of 1972; section 5; Rules apply")
    assert [tuple(r) for r in got] == [("order", "P.O. No. 155 of 1972"), ("article", "Article 90E"), ("section", "Section 5"), ("rule", "Rules")]


def test_rewrites(spark):
    df = spark.createDataFrame([("What is nomination?", "What is the nomination procedure for candidates?"), ("What is Article 90E?", "x"), ("a b c d e f g h i j", "k")], "q string, r string")
    rows = df.select(text.rewrite_needed("q").alias("n"), text.accept_rewrite("q", "r").alias("a")).collect()
    assert [r.n for r in rows] == [True, False, False]
    assert rows[0].a.startswith("What is the") and rows[2].a == "a b c d e f g h i j"


def test_what_the_arrow_steps_do_is_what_the_columns_do(spark):
    """Rules that the pipeline applies inside an Arrow step, against their column forms, line by line and text by text."""
    import os

    from lexloom.operators import chunking, cleaning

    folder = "/root/testdata/sf0.001"
    lines = ["", " ", "া", "া ি", "ক া", "াা ি ী", "a া ি", "12 / 40", "১২/৪০", "0/3", "3 / ", "x 1/2", "ক্ত", "ৈৌ", " া "]
    texts = ["", "এক। দুই।\nতিন", "One. Two! Three?", "no end", "ক" * 50, "a. b.\nc। d", " । "]
    if os.path.isdir(folder):
        texts += [r.text for r in spark.read.parquet(f"{folder}/chunks.parquet").select("text").distinct().collect() if r.text]
        lines += [x for r in spark.read.parquet(f"{folder}/clean_results.parquet").select("cleaned_text").collect() for x in (r.cleaned_text or "").split("\n")]
    by_line = spark.createDataFrame([(x.strip(),) for x in lines], "line string").select("line", text.is_noise_line("line").alias("noise"), text.footer_page("line").isNotNull().alias("page")).collect()
    assert all(cleaning._noise(r.line) == r.noise and cleaning._numbered(r.line) == r.page for r in by_line)
    by_text = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.estimate_tokens("t").alias("n"), text.split_sentences("t").alias("s")).collect()
    assert all(chunking._tokens(r.t) == r.n and chunking._sentences(r.t) == list(r.s) for r in by_text)
