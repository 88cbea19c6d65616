"""Chunks of statutes: packed to a budget of tokens, cited, validated."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import estimate_tokens, nonempty, split_sentences, strip
from lexloom.operators.structure import parse

MAX_TOKENS, LEAST_PREAMBLE = 1000, 50
# Words of titles that citations leave out.
NO_CITED_TITLE = ("P.O.", "সনের", "নং", "No.", "of")


def greedy_groups(sizes: Column, budget: int = MAX_TOKENS) -> Column:
    """Group number of each item when items fill groups in order up to a budget; a group holds at least one item."""
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("group"), F.lit(0).cast("long").alias("filled"))

    def step(s: Column, x: Column) -> Column:
        full = (s["filled"] + x > budget) & (s["filled"] > 0)
        group = s["group"] + full.cast("int")
        return F.struct(F.concat(s["ids"], F.array(group)).alias("ids"), group.alias("group"), F.when(full, x.cast("long")).otherwise(s["filled"] + x).alias("filled"))

    return F.aggregate(sizes, start, step)["ids"]


def pack_sentences(df: DataFrame, key: str, text: str, budget: int = MAX_TOKENS) -> DataFrame:
    """Plain packing: key, chunk_index, n_sentences, tokens and text of each group of sentences."""
    rows = df.select(F.col(key), split_sentences(text).alias("s")).withColumn("n", F.transform("s", estimate_tokens))
    rows = rows.withColumn("g", greedy_groups(F.col("n"), budget))
    items = rows.select(key, F.posexplode(F.arrays_zip("s", "n", "g")).alias("at", "i"))
    grouped = items.groupBy(key, F.col("i.g").alias("chunk_index")).agg(F.array_sort(F.collect_list(F.struct("at", F.col("i.s").alias("s")))).alias("l"), F.sum("i.n").alias("tokens"))
    return grouped.select(key, "chunk_index", F.size("l").alias("n_sentences"), "tokens", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("text"))


def citation(name: Column, hierarchy: Column, title: Column, inserted: Column) -> Column:
    """Citation of a provision, empty without a name."""
    part = lambda label, c: F.when(nonempty(c).isNotNull(), F.concat(F.lit(label), c))
    clean = strip(F.coalesce(title, F.lit("")))
    usable = (F.length(clean) > 3) & (F.length(clean) < 100)
    for w in NO_CITED_TITLE:
        usable = usable & ~clean.contains(w)
    note = F.when(nonempty(inserted).isNotNull(), F.concat(F.lit(" (inserted Section "), inserted, F.lit(")"))).when(usable, F.concat(F.lit(" ("), clean, F.lit(")"))).otherwise("")
    section = F.when(nonempty(hierarchy["section"]).isNotNull(), F.concat(F.lit("Section "), hierarchy["section"], note))
    bracket = lambda label, c: F.when(nonempty(c).isNotNull(), F.concat(F.lit(label + " ("), c, F.lit(")")))
    joined = F.concat_ws(", ", name, part("Part ", hierarchy["part"]), part("Chapter ", hierarchy["chapter"]), part("Article ", hierarchy["article"]), section, bracket("Clause", hierarchy["clause"]), bracket("Sub-clause", hierarchy["sub_clause"]))
    return F.when(nonempty(name).isNotNull(), joined).otherwise("")


def chunk_references(amended: Column, refs: Column) -> Column:
    """The amended law first, then every reference with a target."""
    first = F.when(nonempty(amended).isNotNull(), F.array(F.struct(F.lit("amends").alias("ref_type"), amended.alias("target")))).otherwise(F.array().cast("array<struct<ref_type:string,target:string>>"))
    return F.concat(first, F.filter(F.coalesce(refs, F.array().cast("array<struct<ref_type:string,target:string>>")), lambda r: F.length(strip(r["target"])) > 0))


def validation_errors(text: Column, kind: Column, name: Column, year: Column, section: Column, clause: Column, cited: Column) -> Column:
    """Names of the rules a chunk breaks, in order; none for a valid chunk."""
    t = strip(F.coalesce(text, F.lit("")))
    rules = [
        ("empty text", F.length(t) == 0),
        ("text too short", F.length(t) < 20),
        ("starts inside provision", t.rlike("^[)）]")),
        ("missing act name", nonempty(name).isNull()),
        ("missing or zero year", F.coalesce(year, F.lit(0)) == 0),
        ("section type but no section in hierarchy", (kind == "section") & nonempty(section).isNull()),
        ("clause type but no clause in hierarchy", (kind == "clause") & nonempty(clause).isNull()),
        ("missing citation", nonempty(cited).isNull() & (kind != "preamble")),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(label)) for label, broken in rules]), lambda e: e.isNotNull())


def ends_at_boundary(text: Column, kind: Column) -> Column:
    """Whether a chunk's last line ends a sentence or one of the phrases that stand alone."""
    t = strip(F.coalesce(text, F.lit("")))
    last = F.when(t.contains("\n"), strip(F.substring_index(t, "\n", -1))).otherwise(F.substring(t, -100, 100))
    formal = F.lower(last).rlike(r"p\.o\. no\.|সংক্ষিপ্ত|রহিতকরণ|সনের|নং আইন|অধ্যায়")
    closed = last.rlike("[।.!?]$|।[\"'”]$") | F.lower(last).rlike(r"(?:citation|amendment|provision|proviso|thereunder|accordingly|thereof)[\s.]*$")
    return formal | closed | kind.isin("preamble", "schedule")


def kind_of(section: Column, chapter: Column, article: Column, clause: Column, sub_clause: Column, text: Column) -> Column:
    """Type of a chunk from its place, or from its first words where it has none."""
    head = F.substring(F.lower(text), 1, 200)
    has = lambda c: nonempty(c).isNotNull()
    nowhere = ~has(section) & ~has(article) & ~has(chapter)
    return (
        F.when(nowhere & head.rlike("schedule|তফসিল|পরিশিষ্ট"), "schedule").when(nowhere & head.contains("appendix"), "appendix")
        .when(nowhere & head.rlike("explanation|ব্যাখ্যা"), "explanation").when(nowhere & head.rlike("definition|সংজ্ঞা"), "definition").when(nowhere, "preamble")
        .when(has(sub_clause), "sub_clause").when(has(clause), "clause").when(has(article), "article").when(has(section), "section").when(has(chapter), "chapter").otherwise("act")
    )


def _tokens(text: str) -> int:
    n = len(re.findall("[ঀ-৿]", text))
    return int(n / 2.5 + (len(text) - n) / 4.0)


def _sentences(text: str) -> list[str]:
    runs = re.findall("[^।\n]+।", text)
    parts = [*runs, re.sub("[^।\n]+।", "", text)] if runs else re.split(r"(?<=[.!?])\s+", text)
    return [p.strip() for p in parts if p.strip()]


def _plain(text: str, budget: int) -> list[str]:
    """Texts within the budget: sentences packed in order, words where a sentence alone exceeds it."""
    if _tokens(text) <= budget:
        return [text.strip()]
    out: list[str] = []

    def fill(items: list[str]) -> None:
        group, filled = [], 0
        for x in items:
            n = _tokens(x)
            if group and filled + n > budget:
                out.append(" ".join(group))
                group, filled = [], 0
            group.append(x)
            filled += n
        if group:
            out.append(" ".join(group))

    waiting: list[str] = []
    for s in _sentences(text):
        if _tokens(s) > budget:
            fill(waiting)
            waiting = []
            fill(s.split())
        else:
            waiting.append(s)
    fill(waiting)
    return out


def pieces(text: str | None, budget: int = MAX_TOKENS, lossless: bool = True) -> list[tuple]:
    """(chunk type, text, section, chapter, article, title, inserted, clause, sub_clause) of a document, in order.

    A document without section marks is packed plainly, so that no text is lost; ``lossless=False`` gives it no chunk.
    """
    preamble, sections = parse(text, lossless)
    out: list[tuple] = []
    if not sections and lossless and (text or "").strip():
        return [("preamble", t, "", "", "", "", "", "", "") for t in _plain(text.strip(), budget)]
    if len(preamble.strip()) > LEAST_PREAMBLE:
        parts = [preamble] if _tokens(preamble) <= budget else _sentences(preamble)
        out += [("preamble", p.strip(), "", "", "", "", "", "", "") for p in parts]
    for s in sections:
        place = (s.number, s.chapter, s.article, s.title, s.inserted)
        tops = [i for i, c in enumerate(s.clauses) if c.parent is None]
        if not tops:
            out += [("section", t, *place, "", "") for t in _plain(s.content, budget)]
            continue

        def body(i: int) -> str:
            c = s.clauses[i]
            own = f"({c.ident}) {c.text}"
            inner = [body(j) for j, x in enumerate(s.clauses) if x.parent == i] if lossless else []
            return "\n".join([own, *inner])

        lead = len(s.content) - len(s.content.lstrip())
        intro = s.content[: max(s.clauses[0].start - lead, 0)].strip()
        group: list[int] = []
        filled = base = _tokens(intro)
        made: list[tuple] = []

        def flush() -> None:
            if group:
                children = [c.ident for c in s.clauses if c.parent in group]
                kind = "sub_clause" if children else "clause"
                made.append((kind, "\n".join(body(i) for i in group), s.clauses[group[0]].ident, children[0] if children else ""))
                group.clear()

        for i in tops:
            t = body(i)
            n = _tokens(t)
            if n > budget:
                flush()
                made += [("section", x, s.clauses[i].ident, "") for x in _plain(t, budget)]
                filled = base
                continue
            if group and filled + n > budget:
                flush()
                filled = base
            group.append(i)
            filled += n
        flush()
        out += [(kind, f"{intro}\n\n{t}".strip(), *place, c, sub) for kind, t, c, sub in made]
    return out


def chunk(df: DataFrame, text: str, budget: int = MAX_TOKENS, lossless: bool = True) -> DataFrame:
    """Chunks of documents that carry metadata columns (see ``functions.extract.metadata``), invalid ones marked.

    chunk_index counts within a document before validation, so gaps show what was dropped.
    """
    NAMES = ["chunk_index", "chunk_type", "text", "section", "chapter", "article", "section_title", "inserted_section", "clause", "sub_clause"]

    @F.pandas_udf("array<struct<chunk_index:int,chunk_type:string,text:string,section:string,chapter:string,article:string,section_title:string,inserted_section:string,clause:string,sub_clause:string>>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(NAMES, (i, *p))) for i, p in enumerate(pieces(t, budget, lossless))])

    rows = df.withColumn("_p", F.explode(cut(F.col(text)))).select("*", "_p.*") if "text" not in df.columns else df.withColumnRenamed("text", "_text").withColumn("_p", F.explode(cut(F.col("_text" if text == "text" else text)))).select("*", "_p.*")
    hierarchy = F.struct(F.lit("").alias("part"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("chapter", "article", "section", "clause", "sub_clause")])
    name = F.coalesce(nonempty("act_name"), nonempty("bangla_name"))
    out = rows.withColumn("hierarchy", hierarchy).withColumn("citation", citation(name, F.col("hierarchy"), F.col("section_title"), F.col("inserted_section")))
    errors = validation_errors(F.col("text"), F.col("chunk_type"), name, F.col("act_year"), F.col("section"), F.col("clause"), F.col("citation"))
    out = out.withColumns({"token_count": estimate_tokens("text"), "validation_errors": errors, "refs": chunk_references(F.col("amendment_of"), F.col("law_refs"))})
    valid = F.size("validation_errors") == 0
    flags = F.create_map(F.lit("validated"), valid, F.lit("starts_at_boundary"), valid, F.lit("ends_at_boundary"), valid & ends_at_boundary(F.col("text"), F.col("chunk_type")), F.lit("is_complete_chunk"), valid)
    out = out.withColumns({"valid": valid, "validation": flags, "chunk_id": F.concat_ws("", "source_pdf", F.lit(":s"), "section", F.lit(":c"), F.col("chunk_index").cast("string"))})
    meta = F.struct(name.alias("act_name"), "bangla_name", "act_number", "act_year", "publication_date", "document_type", "source_pdf", "volume", F.lit(1).alias("pdf_page"), "language", "section_title", "chunk_index")
    return out.select("chunk_id", "text", "token_count", "chunk_type", "citation", "hierarchy", "refs", meta.alias("metadata"), "valid", "validation", "validation_errors")


def running_index(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Add chunk_index from 0 within a key."""
    return df.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
