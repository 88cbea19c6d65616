"""Cleaning of paged documents: repeated headers and footers, noise, furniture lines.

A document's pages are one array in its row, so everything is decided inside the row: no shuffle, whatever the size of
the table.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import COPYRIGHT_PHRASES, FOOTER_DOMAINS, strip

HEADER_WINDOW, FOOTER_WINDOW, REPEAT_SHARE = 8, 5, 0.6
_ZERO = re.compile("[\u200b\u200c\u200d\ufeff]")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: key, line_no from 0, line. Null texts have no lines."""
    return df.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def page_lines(df: DataFrame, key: str, pages: str) -> DataFrame:
    """One row per line of paged documents: key, page_no and line_no from 0, line."""
    by_page = df.select(F.col(key), F.posexplode(pages).alias("page_no", "page"))
    return by_page.select(key, "page_no", F.posexplode(F.split("page", "\n")).alias("line_no", "line"))


_SIGNS = frozenset(map(chr, [*range(0x09BE, 0x09C5), 0x09C7, 0x09C8, 0x09CB, 0x09CC]))
_DATE, _DATED = re.compile(r"\d{2}/\d{2}/\d{4}\s+"), re.compile(r"\d{2}/\d{2}/\d{4}\Z")
_PAGE_LINE = re.compile(r"(\d+)\s*/\s*\d+\Z")
_ADDRESS = re.compile("|".join(FOOTER_DOMAINS))


def _noise(line: str) -> bool:
    solid = "".join(line.split())
    n = len(solid)
    if not n or n > 6:
        return False
    signs = sum(c in _SIGNS for c in solid)
    if n <= 4 and 2 * signs >= n:
        return True
    inside = [c for c in solid if "\u0980" <= c <= "\u09ff"]
    return signs >= 2 and bool(inside) and not any(c.isalpha() for c in solid if not "\u0980" <= c <= "\u09ff")


def _numbered(line: str) -> bool:
    m = _PAGE_LINE.match(line)
    return m is not None and int(m.group(1)) > 0


def _frequent(items: list[str], times: int) -> list[str]:
    return sorted(x for x, n in Counter(items).items() if n >= times)


def clean_pages(pages: list[str | None] | None, preserve_first_header: bool = True) -> tuple[str, list[str], list[str], int, int]:
    """Cleaned text, header patterns, removed footers, number of noise lines and of pages of one document."""
    split = [[x.strip() for x in _ZERO.sub("", unicodedata.normalize("NFC", p or "")).split("\n")] for p in (pages if pages is not None else [])]
    times = max(2, int(len(split) * REPEAT_SHARE))
    tops, bottoms = [], []
    for lines in split:
        tops += {x for x in lines[:HEADER_WINDOW] if len(x) >= 3 and not _noise(x)}
        last = [x for x in lines[-FOOTER_WINDOW:] if len(x) >= 3]
        special = [x for x in last if _ADDRESS.search(x) or _numbered(x)]
        bottoms += [*special, *(set(last) - set(special))]
    headers, footers = _frequent(tops, times), _frequent(bottoms, times)
    near = lambda x, patterns: any(p in x or x in p for p in patterns)
    kept: list[str] = []
    removed: list[str] = []
    noise = 0
    for number, lines in enumerate(split):
        taken = 0
        for bare in lines:
            line = _DATE.sub("", bare, count=1) if _DATE.match(bare) else bare
            if not line:
                kept.append("")
            elif footers and near(bare, footers):
                removed.append(line)
            elif _noise(line):
                noise += 1
            elif any(x in line for x in COPYRIGHT_PHRASES):
                continue
            elif _ADDRESS.search(line) or _numbered(line):
                removed.append(line)
            elif (number or not preserve_first_header) and taken < HEADER_WINDOW and near(line, headers):
                taken += 1
            elif number and _DATED.match(line):
                continue
            else:
                kept.append(line)
    text = re.sub(r"(?<=[^\W])-\s*\n\s*(?=[^\W])", "", "\n".join(kept))
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r"\n +", "\n", re.sub(r" +\n", "\n", re.sub(r"\n{3,}", "\n\n", text))).strip()
    return re.sub(r"\n{4,}", "\n\n", text).strip(), headers, removed, noise, len(split)


def clean(df: DataFrame, pages: str, preserve_first_header: bool = True) -> DataFrame:
    """Add cleaned_text, removed_headers, removed_footers, removed_noise_count and source_pages.

    Null pages give an empty text and no removals; null entries count as empty pages. At most eight header lines are
    taken from a page, none from the first one unless asked. One Arrow step: a line's fate depends on what was taken
    before it, which as a fold of column expressions ran fifty times slower.
    """

    @F.pandas_udf("struct<cleaned_text:string,removed_headers:array<string>,removed_footers:array<string>,removed_noise_count:int,source_pages:int>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean_pages(p, preserve_first_header) for p in s], columns=["cleaned_text", "removed_headers", "removed_footers", "removed_noise_count", "source_pages"])

    return df.withColumn("_done", run(pages)).select("*", "_done.*").drop("_done")


def repeating_lines(df: DataFrame, group: str, key: str, text: str, window: int = HEADER_WINDOW, least: int = 2) -> DataFrame:
    """Lines repeated in the first lines of different documents of a group: group, line, n. Pre-aggregated before the shuffle."""
    top = df.select(F.col(group), F.col(key), F.explode(F.array_distinct(F.filter(F.transform(F.slice(F.split(text, "\n"), 1, window), strip), lambda x: F.length(x) >= 3))).alias("line"))
    return top.distinct().groupBy(group, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
