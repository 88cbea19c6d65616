"""Lines repeated across the documents of one source, by PrefixSpan over sequences of line identifiers.

Every file is the sequence of its lines, each replaced by the identifier of its normal form. The first step of
PrefixSpan finds the frequent identifiers of a source, each further step the frequent extensions of frequent
prefixes, by support in distinct files. Occurrences of frequent sequences are taken out; single lines are sequences
of length one, and no line of a longer frequent sequence is itself infrequent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import cut


def normal_line(line):
    """Lines that differ only in case, in blanks or in runs of decimal digits have one normal form."""
    out = F.regexp_replace(F.lower(line), r"\p{Nd}+", "0")
    return F.trim(F.regexp_replace(out, r"[\s\p{Z}]+", " "))


def lines(results: DataFrame, laws: DataFrame) -> DataFrame:
    """file_id, source, place, line_no, line, line_id and letters of every line of every file.

    ``results``: file_id, law_id, cleaned_text, removed_headers, removed_footers; ``laws``: law_id, source_pdf. Exactly
    repeated rows count once, a null text is an empty one. Files whose law or source is unknown are in no source and left out.
    """
    rows = results.select("file_id", "law_id", "cleaned_text", "removed_headers", "removed_footers").distinct()
    sources = laws.select("law_id", F.col("source_pdf").alias("source")).where("law_id is not null and source is not null").distinct()

    def numbered(place: str, array):
        return F.transform(F.coalesce(array, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(place).alias("place"), (i + 1).cast("int").alias("line_no"), x.alias("line")))

    entries = F.flatten(F.array(numbered("body", F.split(F.coalesce("cleaned_text", F.lit("")), "\n")), numbered("header", F.col("removed_headers")), numbered("footer", F.col("removed_footers"))))
    out = rows.join(sources, "law_id").select("file_id", "source", F.explode(entries).alias("e")).select("file_id", "source", "e.*").where("line is not null")
    return out.withColumn("line_id", F.xxhash64(normal_line(F.col("line")))).withColumn("letters", F.length(F.regexp_replace("line", r"[^\p{L}]", "")))


def frequent_lines(every: DataFrame, least_files: int = 4, least_share: float = 0.25, least_letters: int = 12) -> DataFrame:
    """source, line_id, support, needed: identifiers that stand in enough distinct files of their source."""
    files = every.groupBy("source").agg(F.count_distinct("file_id").alias("files"))
    support = every.where(F.col("letters") >= least_letters).select("source", "line_id", "file_id").distinct().groupBy("source", "line_id").agg(F.count("*").alias("support"))
    needed = F.greatest(F.lit(least_files), F.ceil(F.col("files") * least_share))
    return support.join(files, "source").withColumn("needed", needed).where("support >= needed").select("source", "line_id", "support", "needed")


def prefix_span(every: DataFrame, frequent: DataFrame, longest: int | None = None, gaps: bool = True) -> DataFrame:
    """source, pattern array<bigint>, support: frequent subsequences of a file's headers, body lines and footers, in this order.

    Without ``gaps``, a sequence's lines must follow each other with no other frequent line between them; such sequences
    are at most as many as the places of frequent lines in every step, while those with gaps double with every line that a
    masthead has.

    A prefix is held as one row per file with the place of its first match (the projected database); a step joins it
    with the frequent lines that follow in the file and keeps the extensions with support. Steps go on until no prefix
    is frequent, or up to ``longest`` lines.
    """
    if not gaps:
        return _runs(every, frequent, longest)
    order = F.when(F.col("place") == "header", 0).when(F.col("place") == "body", 1).otherwise(2)
    held = every.join(frequent.select("source", "line_id", "needed"), ["source", "line_id"]).withColumn("spot", F.struct(order.alias("part"), "line_no"))
    places = cut(held.groupBy("source", "file_id", "line_id", "needed").agg(F.array_sort(F.collect_set("spot")).alias("places")))
    after = places.select("source", "file_id", F.col("line_id").alias("next"), "places")
    prefix = places.select("source", "file_id", "needed", F.array("line_id").alias("pattern"), F.col("places")[0].alias("at"))
    kept: list[DataFrame] = []
    while True:
        counts = cut(prefix.groupBy("source", "pattern", "needed").agg(F.count("*").alias("support")).where("support >= needed"))
        kept.append(counts.select("source", "pattern", "support"))
        if len(kept) == longest or counts.isEmpty():
            break
        alive = prefix.join(counts.select("source", "pattern"), ["source", "pattern"], "left_semi")
        step = alive.join(after, ["source", "file_id"]).withColumn("then", F.try_element_at(F.filter("places", lambda p: p > F.col("at")), F.lit(1))).where("then is not null")
        prefix = cut(step.select("source", "file_id", "needed", F.concat("pattern", F.array("next")).alias("pattern"), F.col("then").alias("at")))
    return reduce(DataFrame.unionByName, kept)


def _runs(every: DataFrame, frequent: DataFrame, longest: int | None) -> DataFrame:
    """``prefix_span`` without gaps: a prefix is held with the number of its last line in every file and place it matches."""
    order = F.when(F.col("place") == "header", 0).when(F.col("place") == "body", 1).otherwise(2)
    held = every.join(frequent.select("source", "line_id", "needed"), ["source", "line_id"]).select("source", "file_id", "line_id", "needed", F.struct(order.alias("part"), "line_no").alias("spot")).distinct()
    in_order = Window.partitionBy("source", "file_id").orderBy("spot", "line_id")  # the lines of one file
    places = cut(held.withColumn("at", F.row_number().over(in_order)).drop("spot"))
    after = places.select("source", "file_id", F.col("line_id").alias("next"), (F.col("at") - 1).alias("at"))
    prefix = places.select("source", "file_id", "needed", F.array("line_id").alias("pattern"), "at")
    kept: list[DataFrame] = []
    while True:
        files = prefix.select("source", "pattern", "needed", "file_id").distinct()
        counts = cut(files.groupBy("source", "pattern", "needed").agg(F.count("*").alias("support")).where("support >= needed"))
        kept.append(counts.select("source", "pattern", "support"))
        if len(kept) == longest or counts.isEmpty():
            break
        alive = prefix.join(counts.select("source", "pattern"), ["source", "pattern"], "left_semi")
        step = alive.join(after, ["source", "file_id", "at"])
        prefix = cut(step.select("source", "file_id", "needed", F.concat("pattern", F.array("next")).alias("pattern"), (F.col("at") + 1).alias("at")))
    return reduce(DataFrame.unionByName, kept)


def occurrences(every: DataFrame, patterns: DataFrame, least_letters: int = 12) -> DataFrame:
    """file_id, place, line_no of every line that is part of an occurrence of a frequent sequence.

    ``patterns``: source, pattern, of ``prefix_span``. A sequence occurs in a file that holds all its lines in order; every
    place at which one of its lines may stand in such a match counts. A single line is a sequence of length one, and
    matches wherever it stands; so what longer sequences add is looked for only where they hold other lines.
    """
    held = every.where(F.col("letters") >= least_letters)
    single = patterns.where(F.size("pattern") == 1).select("source", F.col("pattern")[0].alias("line_id"))
    hits = held.join(single, ["source", "line_id"], "left_semi").select("file_id", "place", "line_no")
    # lines of longer sequences that are no sequence themselves: none when support is counted in files, as a file that
    # holds a sequence holds its lines; a join that finds nothing keeps the result right for patterns of other origin
    longer = patterns.where(F.size("pattern") > 1).select("source", F.explode("pattern").alias("line_id")).distinct().join(single, ["source", "line_id"], "left_anti")
    return hits.unionByName(held.join(longer, ["source", "line_id"], "left_semi").select("file_id", "place", "line_no")).distinct()


def without_repeated(every: DataFrame, patterns: DataFrame, least_letters: int = 12) -> DataFrame:
    """file_id, cleaned_text, restored: each file without the lines of its volume's frequent sequences; the rest comes back.

    ``patterns``: source, pattern, of ``prefix_span``. ``restored`` holds the entries of removed headers and footers that no
    rule counts as repeated, so that text taken out by mistake is not lost.
    """
    frequent = patterns.select("source", F.explode("pattern").alias("line_id")).distinct()
    marked = every.join(frequent.select("source", "line_id", F.lit(True).alias("hit")), ["source", "line_id"], "left")
    kept = marked.where(F.col("hit").isNull() | (F.col("letters") < least_letters)).select("file_id", "place", "line_no", "line").distinct()
    rows = kept.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("place", "line_no", "line"))).alias("l"))
    pick = lambda *p: F.transform(F.filter("l", lambda x: x["place"].isin(*p)), lambda x: x["line"])
    return rows.select("file_id", F.array_join(pick("body"), "\n").alias("cleaned_text"), pick("footer", "header").alias("restored"))
