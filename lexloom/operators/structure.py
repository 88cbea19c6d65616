"""Structure of statutes: sections with chapter and article, and the clauses inside them.

Offsets of all matches need a scan that SQL has no word for, so a document is parsed in one Arrow step that yields rows;
everything after it is relational. Clauses come as rows with a parent, since a row cannot hold a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.extract import ORDINALS

# Marks of sections, in the order in which they are tried, and words that are no titles.
SECTION_MARKS = (
    ("bengali", re.compile(r"(?:^|\s)([০-৯]{1,2})\s*[.।]")),
    ("article", re.compile(r"(?:^|\s)Article\s+(\d+[A-Za-z]?)\s*[.।:)]?", re.I)),
    ("chapter", re.compile(r"(?:^|\n)\s*CHAPTER\s+([IVXLCDM]+|\d+)\b", re.I)),
    ("number", re.compile(r"(?:^|\n)\s*(\d+[A-Za-z]?)\s*[.．。]")),
)
CLAUSE_MARK = re.compile(r"\s*[(（]\s*([^)）\s]+)\s*[)）]\s*")
NO_TITLE = ("আইন", "সংশোধন", "সনের", "নং", "অধ্যাদেশ", "P.O.", "President", "Order", "No.", "of")
HIGHEST_NUMBER = 200

_IDENTIFIER = re.compile(r"(?:[0-9০-৯]{1,3}|[ক-হ]|[a-z]{1,3})\Z")
_SPECIAL = {"xial", "xiaa", "bis", "ter"}
_CHAPTER = re.compile(r"^\s*(" + "|".join(ORDINALS) + r")\s*অধ্যায়\s*[\n:]?")
_ARTICLE = re.compile(r"(?:^|\s)Article\s+(\d+[A-Za-z]?)", re.I)
_INSERTED = tuple(re.compile(p) for p in (r"নূতন\s+ধারা\s+([০-৯]+[ক-হ]?)", r"নতুন\s+ধারা\s+([০-৯]+[ক-হ]?)", r"ধারা\s+([০-৯]+[ক-হ]?)\s+সন্নিবেশ", r"(?:নূতন|নতুন)\s*Article\s+(\d+[A-Za-z]*)"))
_NUMBERED = re.compile(r"^\s*(?:[০-৯]+\s*[.।]|Article\s+\d+)", re.I)


def is_clause_identifier(mark: str) -> bool:
    return bool(mark) and (mark.lower() in _SPECIAL or _IDENTIFIER.match(mark) is not None)


@dataclass
class Clause:
    ident: str
    text: str
    level: int
    parent: int | None
    start: int
    end: int


@dataclass
class Section:
    number: str
    title: str
    inserted: str
    chapter: str
    article: str
    content: str
    start: int
    end: int
    clauses: list[Clause] = field(default_factory=list)


def _first(patterns, text: str) -> str:
    for p in patterns:
        m = p.search(text)
        if m:
            return m.group(1)
    return ""


def _title(text: str, at: int) -> str:
    """Title of a marker: what stands before it on its line, after the line above unless that is a marker or a citation."""
    begin = text.rfind("\n", 0, at) + 1
    own = text[begin:at].strip()
    if any(w in own for w in NO_TITLE):
        return ""
    above = text[text.rfind("\n", 0, begin - 1) + 1 : begin - 1].strip() if begin > 1 else ""
    parts = []
    if 3 < len(above) < 200 and not _NUMBERED.match(above) and not any(w in above for w in NO_TITLE):
        parts.append(above)
    if 3 < len(own) < 200:
        parts.append(own)
    out = " ".join(parts)
    return out if 3 <= len(out) <= 200 else ""


def clauses_of(text: str, lossless: bool = True) -> list[Clause]:
    """Clauses of a section, none when fewer than two genuine markers stand in it.

    Digits are level 1, letters 2, letters inside a lettered clause 3. ``lossless`` keeps lettered siblings siblings;
    without it, each letter after the first counts as inside it.
    """
    marks = [m for m in CLAUSE_MARK.finditer(text) if is_clause_identifier(m.group(1))]
    if len(marks) < 2:
        return []
    out: list[Clause] = []
    stack: list[int] = []
    for i, m in enumerate(marks):
        ident = m.group(1)
        end = marks[i + 1].start() if i + 1 < len(marks) else len(text)
        single = len(ident) == 1
        if ident[0].isdigit():
            level = 1
        elif lossless:
            level = 2 if single and not (ident in "ivx" and any(len(out[j].ident) > 1 or out[j].ident in "ivx" for j in stack if out[j].level == 3)) else 3
        else:
            level = 3 if any(out[j].level >= 2 for j in stack) or not single else 2
        while stack and out[stack[-1]].level >= level:
            stack.pop()
        out.append(Clause(ident, text[m.end() : end].strip(), level, stack[-1] if stack else None, m.start(), end))
        stack.append(len(out) - 1)
    return out


def parse(text: str | None, lossless: bool = True) -> tuple[str, list[Section]]:
    """Preamble and sections of a document; the first kind of mark that occurs is taken for all of it."""
    text = (text or "").strip()
    marks = []
    for kind, pattern in SECTION_MARKS:
        marks = [m for m in pattern.finditer(text) if kind != "number" or (m.group(1).isdigit() and int(m.group(1)) <= HIGHEST_NUMBER)]
        if marks:
            break
    if not marks:
        return "", []
    sections: list[Section] = []
    chapter = ""
    for i, m in enumerate(marks):
        start, end = m.start(), marks[i + 1].start() if i + 1 < len(marks) else len(text)
        at = m.start(1)
        title = _title(text, at if kind in ("bengali", "article") and kind == "bengali" else text.rfind("Article", 0, at)) if kind in ("bengali", "article") else ""
        found = _CHAPTER.search(title)
        if found:
            chapter, title = f"{found.group(1)} অধ্যায়", _CHAPTER.sub("", title).strip()
        content = text[start:end]
        article = _first((_ARTICLE,), title[:200]) or _first((_ARTICLE,), content[:200])
        s = Section(m.group(1), title, _first(_INSERTED, content[:500]), chapter, article, content.strip(), start, end)
        s.clauses = clauses_of(content, lossless)
        sections.append(s)
    head = text[: sections[0].start].strip()
    return (head if len(head) > 20 else "") if sections[0].start > 0 else "", sections


SECTIONS = "section_no int, section_number string, section_title string, inserted_section_number string, chapter string, article string, section_content string, start_char int, end_char int, clauses array<struct<clause_no:int,parent_no:int,clause_ident:string,text:string,clause_level:int,start_char:int,end_char:int>>"


def sections(df: DataFrame, key: str, text: str, lossless: bool = True) -> DataFrame:
    """One row per section, its clauses as an array with parents by position; documents without marks have none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["body"]):
                for i, s in enumerate(parse(t, lossless)[1]):
                    rows = [{"clause_no": j, "parent_no": c.parent, "clause_ident": c.ident, "text": c.text, "clause_level": c.level, "start_char": c.start, "end_char": c.end} for j, c in enumerate(s.clauses)]
                    out.append((k, i, s.number, s.title, s.inserted, s.chapter, s.article, s.content, s.start, s.end, rows))
            yield pd.DataFrame(out, columns=["key", "section_no", "section_number", "section_title", "inserted_section_number", "chapter", "article", "section_content", "start_char", "end_char", "clauses"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("body"))
    return rows.mapInPandas(run, f"key {kind}, {SECTIONS}").withColumnRenamed("key", key)


def clauses(parsed: DataFrame, key: str) -> DataFrame:
    """One row per clause."""
    return parsed.select(key, "section_no", F.explode("clauses").alias("c")).select(key, "section_no", "c.*")


def chapters(parsed: DataFrame, key: str) -> DataFrame:
    """Chapters of each document in the order they are met."""
    rows = parsed.where("chapter <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_no", "chapter"))).alias("c"))
    return rows.select(key, F.array_distinct(F.transform("c", lambda x: x["chapter"])).alias("chapters"))


def spans(df: DataFrame, key: str, start: str, length: str, *ties: str) -> DataFrame:
    """Add end_pos: each start's next start within its key, the last one's length; ``ties`` order equal starts."""
    order = Window.partitionBy(key).orderBy(start, *ties)
    return df.withColumn("end_pos", F.coalesce(F.lead(start).over(order), F.col(length)))


def forward_fill(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Replace nulls by the last value before them within a key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def previous_line(df: DataFrame, key: str, order: str, line: str) -> DataFrame:
    return df.withColumn("previous_line", F.lag(line).over(Window.partitionBy(key).orderBy(order)))
