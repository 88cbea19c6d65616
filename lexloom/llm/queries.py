"""Queries of the training-data operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import abuse, languages, leaks, lookalikes, mojibake, packing, repeated_lines, scans
from lexloom.llm.sentences import learn_gaps, sentences
from lexloom.session import cut, table


def _values(spark: SparkSession, d: str) -> DataFrame:
    laws = table(spark, d, "law_metadata")
    return reduce(
        DataFrame.unionByName,
        [
            lookalikes.values(table(spark, d, "chunks"), "chunk_text", "chunk_id", "text"),
            lookalikes.values(laws, "act_name", "law_id", "act_name"),
            lookalikes.values(laws, "bangla_name", "law_id", "bangla_name"),
        ],
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows whose values look the same but differ in code points."""
    return lookalikes.look_alike_pairs(_values(spark, d))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every value."""
    return lookalikes.canonical(_values(spark, d)).select("field_name", "row_key", "canon").distinct()


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of rows of one look that every row is in, and the number of its links."""
    return lookalikes.look_alike_classes(_values(spark, d))


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    laws = table(spark, d, "law_metadata").select("law_id", F.col("source_pdf").alias("source")).distinct()
    files = table(spark, d, "loaded_documents").select(F.lit("raw_text").alias("field_name"), F.col("file_id").alias("record_id"), "law_id", F.col("raw_text").alias("value"))
    titles = table(spark, d, "legal_sections").select(F.lit("section_title").alias("field_name"), F.col("section_id").alias("record_id"), "law_id", F.col("section_title").alias("value"))
    return files.unionByName(titles).join(laws, "law_id", "left").select("field_name", "record_id", "source", "value")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Files and section titles that hold text decoded wrongly."""
    return mojibake.records(_decoded(spark, d)).select("field_name", "record_id")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Their text as it was, where it survives."""
    rows = _decoded(spark, d)
    return mojibake.restored(rows, mojibake.records(rows))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every chunk and clause."""
    of_chunks, of_clauses = table(spark, d, "chunks"), table(spark, d, "legal_clauses")
    gaps = learn_gaps([of_chunks.select(F.col("text").alias("unit")), of_clauses.select(F.col("text").alias("unit"))])
    chunks = sentences(of_chunks, "chunk_id", "text", "chunk", gaps)
    clauses = sentences(of_clauses, "clause_id", "text", "clause", gaps)
    return chunks.unionByName(clauses).select("record_kind", "record_key", "sentence_no", "end_char")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    rows = languages.sentence_words(chunks, "chunk_id", "text")
    return cut(languages.tagged_sentences(rows, languages.learn_models(rows)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Right languages of laws whose label is missing or wrong, and the language segments of mixed chunks."""
    tagged = _tagged(spark, d)
    owner = table(spark, d, "chunks").select(F.col("chunk_id").alias("record_key"), F.col("law_id").alias("owner_key")).where("owner_key is not null").distinct()
    right = languages.document_languages(tagged, owner)
    pairs = [F.lit(x) for lang, names in languages.LABELS.items() for name in names.split() for x in (name, lang)]
    laws = table(spark, d, "law_metadata").select("law_id", F.lower(F.trim("language")).alias("label")).distinct()
    labelled = laws.withColumn("named", F.try_element_at(F.create_map(*pairs), F.col("label")))
    wrong = labelled.join(right, labelled["law_id"] == right["owner_key"]).where(F.col("named").isNull() | (F.col("named") != F.col("lang")))
    of_laws = wrong.select(F.lit("law").alias("record_kind"), F.col("law_id").cast("string").alias("record_key"), F.lit(0).alias("segment_no"), "lang").distinct()
    of_chunks = languages.segments(tagged).select(F.lit("segment").alias("record_kind"), "record_key", "segment_no", "lang")
    return of_laws.unionByName(of_chunks)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.lines(table(spark, d, "clean_results"), table(spark, d, "law_metadata"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand in many files of one volume, as parts of its frequent sequences."""
    every = _lines(spark, d)
    return repeated_lines.occurrences(every, repeated_lines.prefix_span(every, repeated_lines.frequent_lines(every), gaps=False))


def p5_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Frequent sequences of lines per volume."""
    every = _lines(spark, d)
    return repeated_lines.prefix_span(every, repeated_lines.frequent_lines(every))


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every file without the lines repeated in its volume."""
    every = _lines(spark, d)
    return repeated_lines.without_repeated(every, repeated_lines.prefix_span(every, repeated_lines.frequent_lines(every), gaps=False))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """Files with pages and their acts' names, without those decoded wrongly.

    Who is in and under which names is settled on keys alone, so that the pages move once.
    """
    every = table(spark, d, "law_metadata")
    laws = every.groupBy("law_id").agg(F.flatten(F.collect_set(F.array("act_name", "bangla_name"))).alias("names"))
    loaded = table(spark, d, "loaded_documents")
    sources = every.select("law_id", F.col("source_pdf").alias("source")).distinct()
    texts = loaded.where(F.size("pages") > 0).select(F.lit("raw_text").alias("field_name"), F.col("file_id").alias("record_id"), "law_id", F.array_join("pages", "\n").alias("value")).join(sources, "law_id", "left")
    wrong = mojibake.records(texts).select(F.col("record_id").alias("file_id"))
    named = loaded.select("file_id", "law_id").distinct().join(laws, "law_id", "left").join(wrong, "file_id", "left_anti")
    names = named.groupBy("file_id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    # hashed, not sorted: the names of a partition are few, its pages are long
    return loaded.where(F.size("pages") > 0).select("file_id", "pages").join(names.hint("shuffle_hash"), "file_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Noise of scanning, page by page."""
    files = _scanned(spark, d)
    return scans.page_noise(files, scans.fit(table(spark, d, "loaded_documents"), "pages"))


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Continuous paragraphs of every file."""
    files = _scanned(spark, d)
    return scans.repaired(files, scans.fit(table(spark, d, "loaded_documents"), "pages"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Containers of every kind, filled with the documents."""
    items = cut(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"))
    kinds = table(spark, d, "pack_sizes").distinct().collect()  # a handful of kinds, fixed
    packed = [packing.pack(items, k["container_kind"], k["capacity_tokens"]) for k in sorted(kinds, key=lambda k: k["capacity_tokens"])]
    return reduce(DataFrame.unionByName, packed or [packing.pack(items.limit(0), "", 1)]).withColumnRenamed("item", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    documents = table(spark, d, "documents")
    net, threshold = abuse.fit(documents, table(spark, d, "review_labels"))
    return abuse.scores(documents, net, ["source"]), threshold


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold abusive, hateful or sexual sentences."""
    scored, threshold = _scored(spark, d)
    return scored.where(F.col("score") >= threshold).select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, d)[0].select("doc_id", F.round("score", 4).alias("score")).distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per source."""
    scored, threshold = _scored(spark, d)
    rows = scored.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("score").alias("score"))
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("abusive"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
