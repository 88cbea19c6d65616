"""Noise of scanned pages: found page by page, and repaired into continuous paragraphs.

Lines that are furniture (page numbers, running headers, stray signs) are told apart first. The words of the rest form
one stream without lines. A lattice over the stream lets every piece stand for itself, be a misreading of a common
word, be joined to the next piece across a hyphen or a blank, or be split in two; the cheapest path is decoded.
Readings that pages confuse are learnt from the corpus: rare words one edit away from common ones. Paragraph boundaries
are chosen by dynamic programming over the lines.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress
from operator import not_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.lookalikes import TO_LATIN, fold
from lexloom.session import cut

# Readings that scans confuse, right and wrong, from which learning starts.
CONFUSIONS = [
    ("e", "c"), ("s", "5"), ("l", "1"), ("l", "|"), ("o", "0"), ("t", "f"), ("h", "b"), ("g", "9"), ("m", "rn"), ("rn", "m"), ("in", "m"), ("ni", "m"), ("d", "cl"), ("cl", "d"),
    ("i", "1"), ("i", "l"), ("u", "ii"), ("w", "vv"), ("b", "6"), ("z", "2"), ("a", "@"), ("B", "8"),
    ("র", "ব"), ("ব", "র"), ("ি", "ী"), ("ক", "ফ"), ("ন", "ণ"), ("ল", "ন"), ("দ", "ছ"), ("ধ", "ঘ"), ("য", "ষ"), ("া", ""),
    ("ि", "ी"), ("ब", "व"), ("व", "ब"), ("घ", "ध"), ("ध", "घ"), ("ा", ""), ("म", "भ"), ("भ", "म"),
]
#: Hyphen-like signs at the end of a line. All but the first are no part of ordinary words.
HYPHENS = "-‐‑\xad¬⁃−"
#: Prices of a join across a blank, and of leaving two pieces apart at a hyphen that ends a line.
JOIN, APART = 8.0, 1e4
_TOKEN = re.compile(r"[^\s.,;:!?।॥“”‘’\"'()\[\]«»…–—·/©£§°&（）。，！？：；《》「」•=+*<>#%~^{}\xad¬‐‑]+")
_CJK = re.compile("[㐀-鿿]")
_DIGITS = r"[0-9০-৯०-९]{1,4}"
_NUMBER = re.compile(
    rf"\s*(?:[-–—|\[(]\s*)*(?:(?:page|pg|p|পৃষ্ঠা|पृष्ठ|folio|seite)\.?\s*)?(?:[-–—|\[(]\s*)*(?:{_DIGITS})(?:\s*(?:/|of|এর|का)\s*{_DIGITS})?\s*(?:[-–—|\])]\s*)*$", re.I
)
_ROMAN = re.compile(r"\s*[-–—\[(|]?\s*(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})\s*[-–—\])|]?\s*$", re.I)
#: The last signs that a line which only numbers a page may have, besides blanks.
_NUMBER_ENDS = frozenset("0123456789০১২৩৪৫৬৭৮৯०१२३४५६७८९-–—|])")
_ROMAN_ENDS = frozenset("ivxlcIVXLCİı-–—|])")
_BARE = re.compile(rf"\s*{_DIGITS}\s*$")
_LABEL = re.compile(r"\s*(?:\([^\s()]{1,4}\)|[0-9০-৯०-९]{1,3}[.।)]|第[0-9一二三四五六七八九十]+[条章])")
_END = re.compile(r"[.!?।॥…。！？:;：；][”’\"')）»」]*\s*$")
_PROSE = re.compile(r"[^\d][.!?।॥…。！？:;：；][”’\"')）»」]*\s*$")


def words(text: str) -> list[str]:
    return _TOKEN.findall(text)


_BROKEN = re.compile("[-\xad¬‐‑][ \t]*\n[ \t]*")


def stray(line: str) -> bool:
    """A line of nothing but dependent signs."""
    signs = "".join(line.split())
    return bool(signs) and not signs[0].isalnum() and not signs.isascii() and all(unicodedata.category(c)[0] == "M" for c in signs)


def numbers_page(line: str, edge: bool) -> bool:
    """A line that only numbers the page; a bare or Roman number does so only at the edge of the page."""
    if not line.strip():
        return False
    last = line.rstrip()[-1]
    if last in _ROMAN_ENDS and _ROMAN.match(line):
        return edge
    return last in _NUMBER_ENDS and bool(_NUMBER.match(line)) and (edge or not _BARE.match(line))


def plain(text: str) -> str:
    """Letters and digits of a title, without case, accents and look-alikes."""
    out = unicodedata.normalize("NFKD", fold(text).translate(_DRAWN)).casefold()
    return " ".join(re.findall(r"[^\W_]+", "".join(c for c in out if unicodedata.category(c) != "Mn" or "ঀ" <= c <= "෿")))


_DRAWN = str.maketrans(TO_LATIN)
_ACCENTS = re.compile("[\u0300-\u036f]+")
_TITLE = re.compile(r"[^\s,.·•|()\[\]–—-]+")
_BEGINS = re.compile(r"(?<!\S)[0-9A-Za-zঅ-হ]")  # words that are sure to be words of a title, whatever it is folded to


@lru_cache(maxsize=20_000)
def _title(text: str) -> tuple[str, ...]:
    return tuple(_parts(text))


def _parts(text: str) -> list[str]:
    if text.isascii():
        return _TITLE.findall(text.casefold())
    out = unicodedata.normalize("NFKD", fold(text).translate(_DRAWN)).casefold()
    return _TITLE.findall(unicodedata.normalize("NFC", _ACCENTS.sub("", out)))


def near(a: str, b: str) -> bool:
    """Equal but for one changed, missing or added character."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def names_act(line: str, titles: list[tuple[str, ...]]) -> bool:
    """Whether a line is the act's name, in full or short, with or without a page number after it."""
    if len(line) > 2 * max((sum(map(len, t)) + len(t) for t in titles), default=0) + 24:  # no form of a name
        return False
    if len(_BEGINS.findall(line)) > max(map(len, titles), default=0) + 1:  # more words than any name and a number
        return False
    got = _title(line)
    if got and got[-1].isdecimal() and len(got) > 2 and (len(got[-1]) < 4 or got[-2].isdecimal()):
        got = got[:-1]
    if len(got) < 2:
        return False
    for name in titles:
        if len(got) > len(name):
            continue
        at, used = 0, 0
        for w in got:
            # one change leaves the first letter or the last
            k = next((j for j in range(at, len(name)) if (name[j][0] == w[0] or name[j][-1] == w[-1]) and near(w, name[j])), None)
            if k is None:
                break
            at, used = k + 1, used + 1
        letters = sum(len(w) for w in got if not w.isdecimal())
        if used == len(got) and letters >= 6 and (len(got) >= 3 or used >= 0.5 * len(name)):
            return True
    return False


class _Plain(dict):
    """Which words stand for themselves, kept up to a bound."""

    def __init__(self, reader: Reader) -> None:
        self.reader = reader

    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        self[word] = got = self.reader.stands(word)
        return got

    def __reduce__(self):
        return _Plain, (self.reader,)


class _Alone(dict):
    """What a text without blanks is when its words are read by themselves, kept up to a bound: 0 if all stand for themselves, 2 if one is misread, else 1."""

    def __init__(self, reader: Reader) -> None:
        self.reader = reader

    def __missing__(self, part: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[part] = got = max(map(self.piece, _TOKEN.findall(part)), default=0)
        return got

    def piece(self, piece: str) -> int:
        word = piece.lower()
        return 0 if self.reader.plain[word] else 1 if self.reader.meant(word) is None else 2

    def __reduce__(self):
        return _Alone, (self.reader,)


class _Ends(dict):
    """The words that a text without blanks begins and ends with, "" where it does so with no word; kept up to a bound."""

    def __missing__(self, part: str) -> tuple[str, str]:
        if len(self) > 300_000:
            self.clear()
        own = _TOKEN.findall(part)
        self[part] = got = own[0].lower() if own and part.startswith(own[0]) else "", own[-1].lower() if own and part.endswith(own[-1]) else ""
        return got


class _Words(dict):
    """The different words of a text without blanks, kept up to a bound."""

    def __missing__(self, part: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        self[part] = got = tuple(words(part.lower()))
        return got


class Reader:
    """Common words of the corpus and what scans make of them."""

    def __init__(self, counts: dict[str, int], confusions: dict[tuple[str, str], float], common: int) -> None:
        self.counts, self.common = counts, common
        self.total = max(sum(counts.values()), 1)
        self.swaps: dict[str, list[tuple[str, float]]] = {}
        self.gaps: list[tuple[str, float]] = []
        for (right, wrong), cost in confusions.items():
            if wrong:
                self.swaps.setdefault(wrong, []).append((right, cost))
            else:
                self.gaps.append((right, cost))
        self.opening = {wrong[0] for wrong in self.swaps}
        self.longest = max(map(len, self.swaps), default=1)
        self.known: dict[str, str | None] = {}
        self.paid: dict[str, float] = {}
        self.plain = _Plain(self)
        self.alone = _Alone(self)
        self.ends = _Ends()
        self._misread: dict[str, list[tuple[str, float]]] | None = None

    def cost(self, word: str) -> float:
        n = self.counts.get(word, 0)
        return math.log(self.total / n) if n else 9.0 + 1.5 * len(word)

    def repairs(self, word: str) -> Iterable[tuple[str, float]]:
        """Words that one confusion turns into this one, without those that begin or end as no word of ``misread``."""
        swaps, opening = self.swaps, self.opening
        index, ends = self.misread, self._ends
        last = len(word) if word[:4] in ends[0] else min(4, len(word))  # the first letters stay where the fifth or a later one changes
        first = 0 if word[-4:] in ends[1] else len(word) - 3
        for i in range(max(first - self.longest, 0), last):
            if word[i] in opening:
                for k in range(1, self.longest + 1):
                    for right, cost in swaps.get(word[i : i + k], ()):
                        if first <= i + k <= len(word) and (part := word[:i] + right + word[i + k :]) in index:
                            yield part, cost
        for right, cost in self.gaps:
            if ord(right) >> 7 != ord(word[0]) >> 7:  # another script
                continue
            for i in range(max(first, 1), min(last, len(word)) + 1):
                if (part := word[:i] + right + word[i:]) in index:
                    yield part, cost

    @property
    def misread(self) -> dict[str, list[tuple[str, float]]]:
        """What one confusion makes of every common word, with the words it may have been; made once a task."""
        if self._misread is None:
            out: dict[str, list[tuple[str, float]]] = {}
            wrongs: dict[str, list[tuple[str, float]]] = {}
            for wrong, rights in self.swaps.items():
                for right, cost in rights:
                    wrongs.setdefault(right, []).append((wrong, cost))
            gaps = dict(self.gaps)
            for word, n in self.counts.items():
                if n < self.common or len(word) < 3:
                    continue
                for i in range(len(word)):
                    for right in (word[i], word[i : i + 2]):
                        for wrong, cost in wrongs.get(right, ()):
                            out.setdefault(word[:i] + wrong + word[i + len(right) :], []).append((word, cost))
                        if len(word) - i == 1:
                            break
                    if i and word[i] in gaps:
                        out.setdefault(word[:i] + word[i + 1 :], []).append((word, gaps[word[i]]))
            self._misread = out
            self._ends = {w[:4] for w in out}, {w[-4:] for w in out}
        return self._misread

    def meant(self, word: str) -> str | None:
        """The common word that a word misreads by one or two confusions, or None if it stands for itself."""
        got = self.known.get(word, "")
        if got == "":
            if len(self.known) > 300_000:
                self.known.clear()
                self.paid.clear()
            own, best, low = self.counts.get(word, 0), None, self.cost(word) + 4.0
            if len(word) >= 3 and not word.isdecimal():
                index = self.misread
                for made, cost in index.get(word, ()):
                    if self.counts[made] >= 20 * own and self.cost(made) + cost < low:
                        low, best = self.cost(made) + cost, made
                if best is None and not own and len(word) >= 6:
                    for part, cost in self.repairs(word):
                        for made, more in index[part]:
                            if made != word and self.cost(made) + cost + more < low:
                                low, best = self.cost(made) + cost + more, made
            if best is not None:
                self.paid[word] = low
            got = self.known[word] = best
        return got

    def reading(self, word: str) -> tuple[float, str]:
        """Price and word of the cheapest reading of one piece."""
        right = self.meant(word)
        return (self.cost(word), word) if right is None else (self.paid[word], right)

    def stands(self, word: str) -> bool:
        """Whether a piece has no reading but itself, and none with its neighbours either."""
        return word.isdecimal() or _CJK.search(word) is not None or self.counts.get(word, 0) >= self.common and self.meant(word) is None

    def halves(self, word: str) -> tuple[float, str] | None:
        """Price and text of the cheapest two common words that make up an unknown one."""
        if len(word) < 6 or self.counts.get(word, 0) or not word.isalpha():
            return None
        least = 5 * self.common
        made = [(self.cost(a) + self.cost(b) + 4.0, f"{a} {b}") for k in range(3, len(word) - 2) if self.counts.get(a := word[:k], 0) >= least and self.counts.get(b := word[k:], 0) >= least]
        return min(made, default=None)

    def path(self, pieces: list[str], gaps: list[str]) -> list[tuple[int, int, str, str]]:
        """The cheapest path through the lattice of pieces, without the edges of pieces that stand for themselves.

        ``gaps``: blank, hyphen, broken (a hyphen no compound has) or "" (neither) after every piece but the last.
        Edges: first piece, end, reading, and misread, split, broken_word or compound. A join that is misread as well has both names.
        """
        best: list[tuple[float, int, str, str]] = [(0.0, 0, "", "")]
        for j, w in enumerate(pieces, 1):
            before = best[j - 1][0]
            price, right = self.reading(w)
            options = [(before + price, j - 1, right, "misread" if right != w else "")]
            if right == w and (two := self.halves(w)) is not None:
                options.append((before + two[0], j - 1, two[1], "split"))
            gap = gaps[j - 2] if j > 1 else ""
            if gap:
                x, whole, start = pieces[j - 2], pieces[j - 2] + w, best[j - 2][0]
                price, right = self.reading(whole)
                name = "broken_word" + (" misread" if right != whole else "")
                known, both = self.counts.get(whole, 0), min(self.counts.get(x, 0), self.counts.get(w, 0)) >= self.common
                if gap == "blank":
                    if not (self.plain[x] and self.plain[w]) and not x.isdecimal() and not w.isdecimal() and not _CJK.search(whole) and (known >= self.common or right != whole and not self.plain[x] and not self.plain[w]):
                        options.append((start + price + JOIN, j - 2, right, name))
                else:
                    options[0] = (options[0][0] + APART, *options[0][1:])
                    options = options[:1]
                    kept = self.counts.get(f"{x}-{w}", 0)
                    if gap == "broken" or known > kept or not kept and not known and (right != whole or not both):
                        options.append((start + price, j - 2, right, name))
                    else:
                        (a, left), (b, after) = self.reading(x), self.reading(w)
                        made = f"{x}-{w}" if kept else f"{left}-{after}"
                        options.append((start + (self.cost(made) if kept else a + b), j - 2, made, "compound" + (" misread" if made != f"{x}-{w}" else "")))
            best.append(min(options))
        out, j = [], len(pieces)
        while j:
            _, i, right, name = best[j]
            if name:
                out.append((i, j, right, name))
            j = i
        return out[::-1]


def furniture(lines: list[str], titles: list[tuple[str, ...]]) -> list[str]:
    """What every line of a page is: text, blank, page_number, running_header or stray_marks."""
    kinds = ["blank" if not x or x.isspace() else "text" if x.isascii() or x[0].isalnum() or not stray(x) else "stray_marks" for x in lines]
    solid = [i for i, k in enumerate(kinds) if k == "text"]
    last = len(solid) - 1
    for k in [*range(min(2, last + 1)), *range(max(last - 2, 0), last + 1)]:
        i = solid[k]
        end = lines[i].rstrip()[-1]
        if kinds[i] == "text" and (end in _NUMBER_ENDS or end in _ROMAN_ENDS):
            edge = k in (0, last) or k > last - 3 and (kinds[solid[k - 1]] != "text" or _END.search(lines[solid[k - 1]]) is not None)
            if numbers_page(lines[i], edge):
                kinds[i] = "page_number"
    for i in solid:
        end = lines[i][-1]
        if (end in _NUMBER_ENDS or end.isspace()) and kinds[i] == "text" and numbers_page(lines[i], False):
            kinds[i] = "page_number"
    head = [i for i in solid if kinds[i] == "text"][:4]
    for i in head:
        if not _LABEL.match(lines[i]) and not _PROSE.search(lines[i]) and names_act(lines[i], titles):
            kinds[i] = "running_header"
    return kinds


def _cased(right: str, w: str) -> str:
    return right.upper() if w.isupper() and len(w) > 1 else right[:1].upper() + right[1:] if w[0].isupper() else right


def _letter(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "M"


def decode(lines: list[str], kinds: list[str], reader: Reader, rewrite: bool = True) -> tuple[list[str], Counter]:
    """The text lines of a page with words mended, and how often a word was broken or misread.

    The words of all lines are the pieces of one lattice, whose cheapest path is taken. A piece that has no other
    reading is on every path, so only the stretches between such pieces are decoded. Without ``rewrite``, lines stay.
    """
    found: Counter = Counter()
    text = [lines[i].rstrip() for i, k in enumerate(kinds) if k == "text"]
    pieces: list[str] = []
    begins, line_of = [0], []  # the first piece of every line, the line of every piece
    for k, line in enumerate(text):
        own = _TOKEN.findall(line)
        if own and k + 1 < len(text) and line[-1] in HYPHENS and len(own[-1]) > 1 and own[-1][-1] == line[-1]:
            own[-1] = own[-1][:-1]
        pieces += own
        line_of += [k] * len(own)
        begins.append(len(pieces))
    spans: dict[int, list[tuple[int, int]]] = {}

    def at(k: int) -> tuple[int, int, int]:
        """Line, start and end of a piece."""
        line = line_of[k]
        if line not in spans:
            spans[line] = [(m.start(), m.end()) for m in _TOKEN.finditer(text[line])]
        start = spans[line][k - begins[line]][0]
        return line, start, start + len(pieces[k])

    low = " ".join(pieces).lower().split(" ") if pieces else []  # no piece holds a blank
    plain, counts = reader.plain, reader.counts
    turns = [begins[k + 1] for k in range(len(text) - 1) if len(text[k]) > 1 and text[k][-1] in HYPHENS and begins[k] < begins[k + 1] < begins[k + 2]]
    open_at = set(compress(range(len(low)), map(not_, map(plain.__getitem__, low))))
    gaps = [""] * max(len(low) - 1, 0)
    for k in turns:
        (a, _, end), b = at(k - 1), at(k)
        line, after = text[a], text[b[0]]
        if end == len(line) - 1 and _letter(line[-2]) and not after[: b[1]].strip() and _letter(after[b[1]]):
            whole = low[k - 1] + low[k]
            capital = pieces[k][0].isupper() and reader.counts.get(whole, 0) == 0
            gaps[k - 1] = "name" if capital else "hyphen" if line[-1] == "-" else "broken"
            open_at |= {k - 1, k}
    near_by = sorted((open_at | {k - 1 for k in open_at} | {k + 1 for k in open_at}) - {-1, len(low)})
    for k in near_by:
        if k + 1 < len(low) and not gaps[k] and not pieces[k + 1][0].isupper():
            if counts.get(low[k] + low[k + 1], 0) < reader.common and (plain[low[k]] or plain[low[k + 1]]):
                continue  # no word could be made of the two
            (a, _, end), (b, start, _) = at(k), at(k + 1)
            between = text[a][end:start] if a == b else text[a][end:] + text[b][:start] if b == a + 1 else "-"
            gaps[k] = "" if between.strip() else "blank"
    edits: list[tuple[int, int, int, str]] = []
    moved = [k for k, g in enumerate(gaps) if g == "name"]  # a compound whose second part opens with a capital
    for k in moved:
        gaps[k] = ""
    n = 0
    while n < len(near_by):
        m = n
        while m + 1 < len(near_by) and near_by[m + 1] == near_by[m] + 1:
            m += 1
        first, last = near_by[n], near_by[m] + 1
        if not rewrite and not any(gaps[first : last - 1]):  # nothing to join: every piece is read by itself
            found["misread"] += sum(not plain[w] and reader.meant(w) is not None for w in low[first:last])
            n = m + 1
            continue
        for i, j, right, name in reader.path(low[first:last], gaps[first : last - 1]):
            i, j = i + first, j + first
            found.update(x for x in name.split() if x in ("broken_word", "misread"))
            if not rewrite:
                continue
            (a, start, end), (b, _, e2) = at(i), at(j - 1)
            if name == "split":
                if not pieces[i][0].isupper():
                    edits.append((a, start, end, right))
            elif j == i + 1:
                edits.append((a, start, end, _cased(right, pieces[i])))
            else:
                own = pieces[i] + ("-" if name.startswith("compound") else "") + pieces[j - 1]
                made = own if right == own.lower() else _cased(right, pieces[i])
                if a == b:
                    edits.append((a, start, e2, made))
                else:
                    edits += [(a, start, len(text[a]), made), (b, 0, e2 + len(text[b][e2:]) - len(text[b][e2:].lstrip()), "")]
        n = m + 1
    if not rewrite:
        return text, +found
    for line, start, end, made in sorted(edits, reverse=True):
        text[line] = text[line][:start] + made + text[line][end:]
    for k in reversed(moved):
        a, b = line_of[k], line_of[k + 1]
        cut_at = next((m.end() for m in _TOKEN.finditer(text[b])), 0)
        if text[a][-1:] in HYPHENS:
            text[a], text[b] = text[a] + text[b][:cut_at].lstrip(), text[b][cut_at:].lstrip()
    return text, +found


def suffers(text: list[str], reader: Reader) -> set[str]:
    """Which of broken_word and misread ``decode`` finds in the text lines of a page.

    Only where a hyphen ends a line, or two pieces with a blank between them may be one word, the lattice is decoded.
    Elsewhere every piece is read by itself, so that what stands between two blanks is looked up whole.
    """
    if any(x.rstrip()[-1:] in HYPHENS for x in text[:-1]):
        return set(decode(text, ["text"] * len(text), reader, rewrite=False)[1])
    parts = "\n".join(text).split()
    alone = list(map(reader.alone.__getitem__, parts))
    if not any(alone):
        return set()
    for k in compress(range(len(parts)), alone):
        if k and _may_join(parts[k - 1], parts[k], reader) or k + 1 < len(parts) and _may_join(parts[k], parts[k + 1], reader):
            return set(decode(text, ["text"] * len(text), reader, rewrite=False)[1])
    return {"misread"} if 2 in alone else set()


def _may_join(left: str, right: str, reader: Reader) -> bool:
    """Whether two texts with a blank between them may be one word, by the pieces on both sides of the blank."""
    x, y = reader.ends[left][1], reader.ends[right][0]
    if not x or not y or right[0].isupper():
        return False
    return reader.counts.get(x + y, 0) >= reader.common or not (reader.plain[x] or reader.plain[y])


def paragraphs(lines: list[str]) -> list[str]:
    """Paragraphs of mended lines, boundaries chosen by dynamic programming over line ends."""
    lines = [x.strip() for x in lines if x.strip()]
    if not lines:
        return []
    width = sorted(map(len, lines))[int(0.9 * (len(lines) - 1))]
    # inside[k]: cost of all joints up to the one before line k, so that of a paragraph is a difference of two
    inside, best = [0.0, 0.0], [(0.0, 0)]
    for k in range(1, len(lines)):
        before, now = lines[k - 1], lines[k]
        inside.append(inside[-1] + (9.0 if _LABEL.match(now) else 0.0) + (2.5 if _END.search(before) and len(before) < 0.75 * width else 0.0))
    start = (9e9, 0)  # the cheapest start of a paragraph so far
    for j in range(1, len(lines) + 1):
        start = min(start, (best[j - 1][0] + 2.0 - inside[j], j - 1))
        cost = start[0] + inside[j]
        if j < len(lines):
            cost += 0.0 if _LABEL.match(lines[j]) else 4.0 if not _END.search(lines[j - 1]) else 1.0
        best.append((cost, start[1]))
    out, j = [], len(lines)
    while j:
        i = best[j][1]
        out.append(" ".join(lines[i:j]))
        j = i
    return out[::-1]


def vocabulary(files: DataFrame, pages: str) -> tuple[dict[str, int], int, DataFrame, int]:
    """Numbers of files that hold each frequent word, the number of files, all words with theirs, and the least count kept.

    A word is common in a hundredth of the files, and stands for itself where it has a twentieth of a common word's
    files, so counts from one file of two thousand decide everything. Such words are at most two thousand times as many as
    the different words of a mean file, whatever the number of files; the rest stays distributed.
    """
    rows = files.select(F.col(pages).alias("pages")).where(F.size("pages") > 0)
    n_files = rows.count()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        own = _Words()
        for pdf in batches:
            for ps in pdf["pages"]:
                parts = set(_BROKEN.sub("", "\f".join(p for p in ps if p)).split())  # no word goes on after a form feed
                total.update(set(chain.from_iterable(map(own.__getitem__, parts))))
            if len(total) > 500_000:
                yield pd.DataFrame([x for x in total.items() if not _CJK.search(x[0])], columns=["word", "n"])
                total = Counter()
        yield pd.DataFrame([x for x in total.items() if not _CJK.search(x[0])], columns=["word", "n"])

    counted = cut(rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    least = max(2, n_files // 2000)
    kept = counted.where(F.col("n") >= least).toPandas()
    return dict(zip(kept["word"], kept["n"])), n_files, counted, least


def learn_confusions(counts: dict[str, int], rare: DataFrame, common: int, support: int = 5) -> dict[tuple[str, str], float]:
    """Costs of confusions: the fixed ones, and edits by which many different rare words differ from common ones."""
    targets = {w for w, n in counts.items() if n >= common and len(w) >= 5 and w.isalpha() or "ঀ" <= w[:1] <= "৿" and n >= common and len(w) >= 5}
    shorter: dict[str, list[str]] = {}
    for w in targets:
        for i in range(len(w)):
            shorter.setdefault(w[:i] + w[i + 1 :], []).append(w)

    def edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[tuple[str, str, str], float] = {}
        for pdf in batches:
            for w in pdf["word"]:
                if len(w) < 4 or w in targets:
                    continue
                near_by = set(shorter.get(w, ()))
                for i in range(len(w)):
                    cut = w[:i] + w[i + 1 :]
                    near_by.update(shorter.get(cut, ()))
                    if cut in targets:
                        near_by.add(cut)
                for c in near_by:
                    i = 0
                    while i < min(len(w), len(c)) and w[i] == c[i]:
                        i += 1
                    j = 0
                    while j < min(len(w), len(c)) - i and w[-1 - j] == c[-1 - j]:
                        j += 1
                    right, wrong = c[i : len(c) - j], w[i : len(w) - j]
                    if len(right) <= 1 and len(wrong) <= 1:
                        out[right, wrong, c] = max(1 / len(near_by), out.get((right, wrong, c), 0.0))
        yield pd.DataFrame([(*k, x) for k, x in sorted(out.items())], columns=["right", "wrong", "target", "share"])

    # a rare word with several common neighbours shares its evidence among them
    shares = rare.select("word").mapInPandas(edits, "right string, wrong string, target string, share double").groupBy("right", "wrong", "target").agg(F.max("share").alias("share"))
    learnt = shares.groupBy("right", "wrong").agg(F.sum("share").alias("n")).where(F.col("n") >= support).toPandas()
    return confusion_costs(learnt.itertuples(index=False, name=None), targets)


def confusion_costs(learnt: Iterable[tuple[str, str, float]], targets: set[str]) -> dict[tuple[str, str], float]:
    """Costs of the fixed confusions and of all learnt ones, each by its own evidence.

    The rarer a pair is among the common words that have its right side, the dearer it is: 4 if every one of them is
    met misread, one more for each factor of e. A fixed confusion never costs more than without evidence.
    """
    letters = Counter(c for w in targets for c in set(w))
    out = {pair: 6.0 for pair in CONFUSIONS}
    for right, wrong, n in learnt:
        price = 4.0 + math.log(max(letters.get(right, 0) if right else len(targets), n) / n)
        if (right, wrong) in out:
            out[right, wrong] = min(6.0, price)
        elif right and wrong and wrong != "\ufffd" and not (right.isdecimal() or wrong.isdecimal()):  # what a decoder lost is no misreading
            out[right, wrong] = price
    return out


def fit(files: DataFrame, pages: str) -> Reader:
    counts, n_files, every, _ = vocabulary(files, pages)
    common = max(8, n_files // 100)
    return Reader(counts, learn_confusions(counts, every.where(F.col("n") < max(2, n_files // 1000)), common), common)


def _titles(names: Iterable[str | None]) -> list[tuple[str, ...]]:
    return [t for t in (_title(x) for x in names if x) if len(t) >= 2]


def page_noise(files: DataFrame, reader: Reader) -> DataFrame:
    """file_id, page_no, noise: what each page suffers from.

    ``files``: file_id, pages, names (of the act, any of them null). Files without pages have no noise.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, pages, names in zip(pdf["file_id"], pdf["pages"], pdf["names"]):
                titles = _titles(names if names is not None else [])
                for no, page in enumerate(pages, 1):
                    if not page:
                        continue
                    lines = page.split("\n")
                    kinds = furniture(lines, titles)
                    noise = {*kinds, *suffers([x for x, k in zip(lines, kinds) if k == "text"], reader)} - {"text", "blank"}
                    out += [(file, no, x) for x in sorted(noise)]
            yield pd.DataFrame(out, columns=["file_id", "page_no", "noise"])

    return files.where(F.size("pages") > 0).mapInPandas(look, "file_id long, page_no int, noise string").distinct()


def repaired(files: DataFrame, reader: Reader) -> DataFrame:
    """file_id, paragraph_no, text: continuous paragraphs of every file, furniture left out and words mended."""

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, pages, names in zip(pdf["file_id"], pdf["pages"], pdf["names"]):
                titles = _titles(names if names is not None else [])
                lines: list[str] = []
                kinds: list[str] = []
                for page in pages:
                    own = (page or "").split("\n")
                    kinds += furniture(own, titles)
                    lines += own
                text, _ = decode(lines, kinds, reader)
                out += [(file, no, p) for no, p in enumerate(paragraphs(text), 1)]
            yield pd.DataFrame(out, columns=["file_id", "paragraph_no", "text"])

    return files.where(F.size("pages") > 0).mapInPandas(mend, "file_id long, paragraph_no int, text string").distinct()
