"""Sentence units of texts in spaced and spaceless scripts.

Spaced scripts: every run of terminators is a node of a lattice, an edge is a possible sentence, and dynamic
programming takes the cheapest path. The cost of an edge counts quotations and brackets it leaves open, and the gap
at its end is priced from the word before it, the word after it and the state of quotations. Spaceless scripts: the
dictionary, the words that close sentences and those that open them are learnt from the corpus, where end marks show
them. Runs are cut over a lattice of the dictionary's words. An end mark ends a sentence; after a closing quotation, verbs
that report or words that carry on decide. In a paragraph without end marks every gap between two words is a candidate,
classified by the word that closes and the word that opens there.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

# Abbreviations that never end a sentence before a capital, digit or name.
ABBREVIATIONS = frozenset(
    """dr mr mrs ms prof gen col maj capt lt sgt st ft mt messrs hon rev jr sr vs v cf viz ibid approx art arts cl para paras
    sch no nos rs tk fig figs s ss sec secs ch pp p vol vols asst dept govt b d ed eds e.g i.e jan feb mar apr jun jul aug sep
    sept oct nov dec m mm mme mlle mmes p.ex j.o al chap dir reg ord per cent inc co ltd tel ave""".split()
)
# Abbreviations that may end a sentence when a new one opens after them.
FINAL_ABBREVIATIONS = frozenset("etc a.m p.m inc ltd co cent jr sr al ibid".split())
# Words after a closing quotation that carry its sentence on.
CARRY_ON = frozenset(
    """বলিয়া বলে বলেন এবং ও কিন্তু বলিল বলিয়াছেন জানায় कहकर और ने कहा तथा परन्तु लेकिन ऐसा
    bole ebong and or but et a ont mais ou""".split()
)
ZH_CARRY_ON = ("并且", "并", "而", "但", "然后", "后", "等", "的", "和", "及")
# Last words of a clause that report a quotation.
ZH_REPORTS = ("这样主张", "主张", "表示", "说", "道", "称", "答复", "宣布", "写道", "认为")
#: Words that every dictionary holds.
ZH_WORDS = frozenset([*ZH_CARRY_ON, *ZH_REPORTS])

INVISIBLE = dict.fromkeys(map(ord, "­͏؜᠎​‌‍‎‏⁠﻿"))
_VEIL = re.compile("[­͏؜᠎​‌‍‎‏⁠﻿]")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], 0x20)
_OPEN, _CLOSE = "“«「『(（[《", "”»」』)）]》"
_PAIR = dict(zip(_CLOSE, _OPEN)) | {")": "(", "）": "("}
_PARAGRAPH = re.compile(r"\n[ \t\r\f\v 　]*(?:\n\s*)+")
_MARK = re.compile(r"[.!?।॥…。！？]+|[“”«»「」『』()\[\]《》]")
_BEFORE = re.compile(r"[^\s“”«»()\[\]「」]+$")
_AFTER = re.compile(r"\s*((?:[“«「『(\[‘'\"]\s*)*[^\s]*)")
_LABEL = re.compile(r"^\s*(?:\(\s*[^\s()]{1,5}\s*\)\s*|[0-9০-৯०-९]{1,4}[.।)]\s*|[A-Za-z][.)]\s+)*$")
_NUMBER = re.compile(r"(?:^|[.!?।॥…”»)]\s*|\n\s*)[0-9০-৯०-९]{1,4}$")
_SPACELESS = re.compile("[㐀-䶿一-鿿぀-ヿ฀-๿]")
_INDIC = re.compile("[ऀ-෿]")
_RUN = re.compile("[㐀-鿿]+")


def words_of_run(run: str, dictionary: frozenset[str] = ZH_WORDS) -> list[str]:
    """Cheapest path through the word lattice of a spaceless run: a dictionary word costs 1, another character 1.5."""
    top = _longest_word(dictionary)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(run) + 1):
        best.append(min((best[i][0] + (1.0 if (w := run[i:j]) in dictionary else 1.5 if len(w) == 1 else 9e9), i) for i in range(max(0, j - top), j)))
    out, j = [], len(run)
    while j:
        i = best[j][1]
        out.append(run[i:j])
        j = i
    return out[::-1]


@lru_cache(maxsize=8)
def _longest_word(dictionary: frozenset[str]) -> int:
    return max(map(len, dictionary), default=1)


@dataclass(frozen=True)
class Gaps:
    """What a corpus shows of a spaceless script: its words, and how much a word speaks for a sentence's end or start."""

    words: frozenset[str] = ZH_WORDS
    closing: dict[str, float] = field(default_factory=dict)
    opening: dict[str, float] = field(default_factory=dict)
    prior: float = -3.0
    mean: float = 30.0

    def ends(self, run: str) -> list[tuple[int, float]]:
        """Places in an unmarked run where a sentence may end, with the price of ending it there (below 0 for an end)."""
        words = words_of_run(run, self.words)
        out, at = [], 0
        for a, b in zip(words, words[1:]):
            at += len(a)
            odds = self.prior + _of_word(self.closing, a, False) + _of_word(self.opening, b, True)
            if odds > 0:
                out.append((at, -odds))
        return out


def _of_word(known: dict[str, float], word: str, first: bool) -> float:
    """The log ratio of a word, or of its longest known beginning or end."""
    for n in range(len(word), 0, -1):
        part = word[:n] if first else word[-n:]
        if part in known:
            return known[part]
    return -3.0


NO_GAPS = Gaps()


def learn_gaps(units: list[DataFrame], column: str = "unit", least: int = 5, share: float = 2e-6) -> Gaps:
    """The dictionary and the closing and opening words of the spaceless text of all rows.

    Strings of one to four letters are counted, and those before end marks and after them. A string is a word if it
    is met ``least`` times and its parts would come together by chance far less often. Only strings with at least
    ``share`` of all places reach the driver, which bounds them whatever the size of the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for t in pdf[column]:
                for m in _RUN.finditer(t):
                    run, (b, e) = m.group(), m.span()
                    for n in (1, 2, 3, 4):
                        total.update(("word", run[i : i + n]) for i in range(len(run) - n + 1))
                    if t[e : e + 1] and t[e] in "。！？":
                        total.update(("closing", run[-n:]) for n in (1, 2, 3) if n <= len(run))
                        total["ends", ""] += 1
                    if not t[:b].rstrip("“「『（( \n") or t[:b].rstrip("“「『（( \n”」』）)")[-1:] in "。！？":
                        total.update(("opening", run[:n]) for n in (1, 2, 3) if n <= len(run))
            if len(total) > 500_000:
                yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["what", "gram", "n"])
                total = Counter()
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["what", "gram", "n"])

    rows = reduce(DataFrame.unionByName, [u.select(column) for u in units]).where(F.col(column).rlike("[㐀-鿿]"))
    counted = cut(rows.mapInPandas(count, "what string, gram string, n long").groupBy("what", "gram").agg(F.sum("n").alias("n")))
    places = counted.where("what = 'word' and length(gram) = 1").agg(F.sum("n")).first()[0] or 0
    got = counted.where(F.col("n") >= max(least, int(share * places))).toPandas()
    by = {what: dict(zip(part["gram"], part["n"])) for what, part in got.groupby("what")}
    grams, ends = by.get("word", {}), by.get("ends", {}).get("", 0)
    if not ends:
        return NO_GAPS
    words = {g for g, n in grams.items() if len(g) > 1 and all(n * places > 10 * grams[g[:i]] * grams[g[i:]] for i in range(1, len(g)))}
    ratio = lambda part: {g: math.log((n + 0.5) * places / ((grams.get(g, n) + 0.5) * ends)) for g, n in part.items()}
    return Gaps(frozenset(words | ZH_WORDS), ratio(by.get("closing", {})), ratio(by.get("opening", {})), math.log(ends / places), places / ends)


def _opens(word: str) -> bool:
    """Whether a word can open a sentence: no small letter."""
    for c in word:
        if c in "“«「『([‘'\"" or c.isspace():
            continue
        return not c.islower()
    return False


def _gap(text: str, start: int, end: int, quoted: bool, sentence: int, dictionary: frozenset[str] = ZH_WORDS) -> float:
    """Price of ending a sentence at ``end``; below 0 speaks for an end. ``start``: of the terminators."""
    after = _AFTER.match(text, end).group(1)
    if not after:
        return -5.0
    mark, spaced = text[start:end].rstrip("".join(_CLOSE)), end < len(text) and text[end].isspace()
    head = after.lstrip("“«「『([‘'\" \n\t")
    if _SPACELESS.match(text[start - 1 : start]) or mark[-1:] in "。！？" or (mark[-1:] in "…!?" and _SPACELESS.search(text[max(sentence, start - 2) : start])):
        if mark[-1:] == ".":
            return 5.0
        if quoted:
            run = _RUN.match(text, end)
            if run:
                first = words_of_run(run.group(), dictionary)[0]
                if first in ZH_CARRY_ON or run.group().startswith("并"):
                    return 5.0
                if not text[sentence:start].lstrip().startswith(("“", "「", "『", "«")):
                    return -5.0
                stop = re.compile(r"[。！？.!?…“”\n]").search(text, end)
                last = words_of_run(re.sub("[^㐀-鿿]", "", text[end : stop.start() if stop else len(text)]), dictionary)
                return 5.0 if last and any(last[-1].endswith(x) for x in ZH_REPORTS) else -5.0
        return -5.0
    if mark.startswith("।") or mark.startswith("॥"):
        if quoted and head.rstrip(",") in CARRY_ON:
            return 5.0
        return -5.0
    if mark[-1:] in "!?":
        if not spaced and not (quoted or _opens(after)):
            return 5.0
        if head.strip(",") in CARRY_ON and (quoted or not _INDIC.match(head)):
            return 5.0
        return -5.0 if _opens(after) else 5.0
    if mark[-1:] == "…" or mark.startswith(".."):
        return -5.0 if _opens(after) and spaced and not (start and text[start - 1].isspace()) else 5.0
    if not spaced:
        return 5.0
    if quoted:
        return 5.0 if head.strip(",") in CARRY_ON or not _opens(after) else -5.0
    found = _BEFORE.search(text, max(sentence, start - 24), start)
    before = found.group() if found else ""
    if _INDIC.search(before):
        return -2.0 if len(before) > 5 and not _INDIC.match(head) and _opens(after) and "." not in before else 5.0
    if not _opens(after):
        return 5.0
    low = re.split("[’'–-]", before.lower())[-1].lstrip("‘\",;")
    if low in FINAL_ABBREVIATIONS:
        return -1.0 if not after[0].isdigit() and low not in ("co", "inc", "ltd", "jr", "sr") else 2.0
    if low in ABBREVIATIONS or (len(low) == 1 and low.isalpha()) or re.fullmatch(r"(?:[a-z]\.)+[a-z]", low):
        return 5.0
    return -4.0


def _paragraph(text: str, offset: int, gaps: Gaps = NO_GAPS) -> Iterator[tuple[int, int]]:
    """Sentence spans of one paragraph, by the lattice of its terminators."""
    lo = len(text) - len(text.lstrip())
    hi = len(text.rstrip())
    if lo >= hi:
        return
    nodes: list[tuple[int, int, tuple, bool]] = []  # start of marks, end with closers, open brackets, whether quoted
    stack: list[tuple[str, int]] = []
    pending = None
    for m in _MARK.finditer(text, lo, hi):
        s, c = m.start(), m.group()
        if c[0] in _OPEN:
            if c[0] not in "“«「『" and pending is not None and pending[1] == s:
                pending = None
            stack.append((c[0], s))
        elif c[0] in _CLOSE:
            opened = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == _PAIR[c[0]]:
                    opened = stack[k][1]
                    del stack[k:]
                    break
            ended = pending if pending is not None and not text[pending[1] : s].strip() else None
            if ended is not None:
                pending = (ended[0], m.end())
                nodes.append((ended[0], m.end(), tuple(x for x, _ in stack), (c[0] in "”»」』") or ("(" if opened is None else opened)))
            continue
        else:
            pending = (s, m.end())
            if c[0] == "।" and _NUMBER.search(text, max(lo, s - 8), s):  # a number that marks the next sentence
                continue
            if c == "." and text[s - 1 : s].isdigit() and nodes and nodes[-1][1] < s and _NUMBER.search(text, max(lo, s - 8), s) and _gap(text, nodes[-1][0], nodes[-1][1], False, lo, gaps.words) < 0:
                continue
            nodes.append((s, m.end(), tuple(x for x, _ in stack), False))
    if gaps.opening and not nodes and hi - lo > 2 * gaps.mean:  # a spaceless paragraph without end marks
        for m in _RUN.finditer(text, lo, hi):
            nodes += [(m.start() + at, m.start() + at, (), price) for at, price in gaps.ends(m.group())]
    # nodes overtaken by a closer at the same place stay as alternatives; the open brackets price them
    n = len(nodes)
    if not n:
        yield offset + lo, offset + hi
        return
    spans: list[int] = []
    at = lo
    best = [(0.0, -1)]  # cheapest price of a path that ends at node j - 1
    ends = [lo]
    seen: list[tuple] = [()]
    sure = [True]
    for j in range(n):
        s, e, opened, quoted = nodes[j]
        cheapest = (9e9, -1)
        far = None  # the gap's price for all starts that it does not look back to
        for i in range(len(best) - 1, -1, -1):
            price, begin = best[i][0], ends[i]
            if price >= 9e9 or begin > s:
                continue
            if e - begin < 14 and _LABEL.match(text[begin:e]):
                continue
            cost = price + 20.0 * (seen[i] != opened)
            if isinstance(quoted, float):  # a gap between two words
                if cost + quoted < cheapest[0]:
                    cheapest = (cost + quoted, i)
                continue
            if quoted not in (True, False):  # a bracket closed here
                own = quoted != "(" and not text[begin:quoted].strip(" \n\t") or (quoted != "(" and _LABEL.match(text[begin:quoted]) is not None)
                cost += -4.0 if own and _gap(text, s, e, False, begin, gaps.words) < 3 else 5.0
            elif cost < 15 + price:
                if quoted is True or begin > s - 24:
                    cost += _gap(text, s, e, quoted is True, begin, gaps.words)
                else:
                    far = _gap(text, s, e, False, begin, gaps.words) if far is None else far
                    cost += far
            else:
                cost += 5.0
            if cost < cheapest[0]:
                cheapest = (cost, i)
            if sure[i]:  # every path may as well start here: no earlier start is cheaper
                break
        best.append(cheapest)
        sure.append(not opened and cheapest[1] >= 0 and cheapest[0] < best[cheapest[1]][0] - 3)
        ends.append(e)
        seen.append(opened)
    # the rest of the paragraph ends it
    final = (9e9, 0)
    for i in range(len(best)):
        rest = text[ends[i] : hi].strip()
        cost = best[i][0] + (0.0 if not rest else 1.0) + 20.0 * bool(seen[i])
        if rest and not any(c.isalnum() for c in rest):
            cost += 9.0
        if cost <= final[0]:
            final = (cost, i)
    i = final[1]
    if ends[i] < hi and text[ends[i] : hi].strip():
        spans.append(hi)
    while i > 0:
        spans.append(ends[i])
        i = best[i][1]
    for e in reversed(spans):
        while at < e and text[at].isspace():
            at += 1
        if at < e:
            yield offset + at, offset + e
        at = e


def split(text: str | None, gaps: Gaps = NO_GAPS) -> list[tuple[int, int]]:
    """(begin, end) of every sentence of a text, in code points from 0, end exclusive; none for null or blank texts."""
    if not text or text.isspace():
        return []
    plain = text.translate(_WIDE) if not text.isascii() else text
    places = None
    if _VEIL.search(plain):
        places = [i for i, c in enumerate(plain) if ord(c) not in INVISIBLE]
        plain = plain.translate(INVISIBLE)
    out: list[tuple[int, int]] = []
    at = 0
    for m in _PARAGRAPH.finditer(plain):
        out.extend(_paragraph(plain[at : m.start()], at, gaps))
        at = m.end()
    out.extend(_paragraph(plain[at:], at, gaps))
    if places is not None:
        out = [(places[b], places[e - 1] + 1) for b, e in out]
    return out


def sentences(df: DataFrame, key: str, text: str, kind: str, gaps: Gaps = NO_GAPS) -> DataFrame:
    """Sentence units of every text: record_kind, record_key, sentence_no from 1, begin_char and end_char from 1.

    Exactly repeated rows count once. A null, empty or blank text has no sentence. Columns other than ``key`` and
    ``text`` are ignored, so names may clash freely. A text of any length is cut as a whole. ``gaps``: of ``learn_gaps``.
    """
    rows = df.select(F.col(key).cast("string").alias("record_key"), F.col(text).alias("unit")).where(F.col("unit").isNotNull()).distinct()

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, nos, begins, ends = [], [], [], []
            for k, t in zip(pdf["record_key"], pdf["unit"]):
                found = split(t, gaps)
                keys += [k] * len(found)
                nos += range(1, len(found) + 1)
                begins += [b + 1 for b, _ in found]
                ends += [e for _, e in found]
            yield pd.DataFrame({"record_key": pd.Series(keys, dtype=object), "sentence_no": nos, "begin_char": begins, "end_char": ends})

    out = rows.mapInPandas(units, "record_key string, sentence_no int, begin_char int, end_char int")
    return out.select(F.lit(kind).alias("record_kind"), "record_key", "sentence_no", "begin_char", "end_char")
