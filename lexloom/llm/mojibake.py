"""Text decoded with the wrong code page: a substitution cipher per source, learnt by expectation-maximisation.

Text read with a wrong code page replaces every byte by one character, the same all over the file: a substitution
cipher whose plaintext are bytes, either the bytes of UTF-8 or the letters of a single-byte page. For every source the
bigrams of characters in tokens with unusual characters are counted, and expectation-maximisation against the bigrams
of the corpus' bytes estimates a mixture of ciphers beside clean text. Existing code
pages are where ciphers start; the byte of every character that a page lacks is free, and bigrams that none of these
explain start a cipher all of whose characters are free. The table learnt is applied with ``str.translate``; a token
counts as wrongly decoded if its decryption reads better than itself, or if a decoder's sign for what it lost is in it.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

# Single-byte code pages that start the mappings.
PAGES = "cp1252 latin_1 cp437 cp850 cp1251 koi8_r mac_roman cp866 iso8859_5 cp1250 iso8859_2 cp1253 iso8859_7 cp852 mac_cyrillic cp1254".split()
#: Plaintexts: bytes of UTF-8, letters of the Western single-byte page, or bytes of the Chinese double-byte page.
FORMS = ("utf8", "legacy", "double")
_LOST = re.compile("�|\\?{3,}")
# characters of no script that has a block of thousands or bytes of three in UTF-8 in the corpus: those of the code pages
_ODD = re.compile("[\x80-\u02ff\u0370-\u08ff\u0e00-\u1fff\ufffd]|[\u2010-\u2bff]{2}")
_HAN = re.compile("[㐀-鿿]")
_HIGH = re.compile("[^\x00-\x7f]+")
_WESTERN = re.compile(f"[{re.escape(bytes(range(256)).decode('cp1252', 'ignore'))}]*")


def tokens(text: str) -> list[str]:
    """Tokens between ASCII blanks, empty ones too; other blanks may stand for bytes."""
    for c in "\t\n\r\f\v":  # many times as fast as an expression that finds the blanks
        text = text.replace(c, " ")
    return text.split(" ")


def odd(token: str) -> bool:
    return not token.isascii() and _ODD.search(token) is not None


@lru_cache(maxsize=1)
def pages() -> dict[str, dict[int, str]]:
    """Byte to character of every page; bytes a page leaves open come through as control characters."""
    out = {}
    for name in PAGES:
        table = {}
        for b in range(0x80, 0x100):
            try:
                table[b] = bytes([b]).decode(name)
            except UnicodeDecodeError:
                table[b] = chr(b)
        out[name] = table
    return out


def foreign(word: str) -> bool:
    """Whether some page turns a run of a word's unusual characters into UTF-8 as a whole: no word of a language then."""
    for run in _HIGH.findall(word):
        if len(run) > 1:
            for table in _backward().values():
                raw = run.translate(table)
                if all(ord(c) < 256 for c in raw):
                    try:
                        raw.encode("latin-1").decode("utf-8")
                        return True
                    except UnicodeDecodeError:
                        pass
    return False


@lru_cache(maxsize=1)
def _backward() -> dict[str, dict[int, int]]:
    return {name: {ord(c): b for b, c in t.items()} for name, t in pages().items()}


def kind(c: str) -> str:
    """A letter itself, or one sign for all of its block where a script has thousands."""
    o = ord(c)
    return c if o < 0x2E80 or o == 0xFFFD else chr(o - o % 0x1000)


def _pairs(words: dict[str, int], kinds: bool, apart: int = 1) -> Iterator[tuple[str, str, int]]:
    """Weighted pairs of characters so far apart in words, blanks at both ends; characters or their kinds."""
    if not words:
        return
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if kinds:
        c = np.where((c < 0x2E80) | (c == 0xFFFD), c, c - c % 0x1000)
    if len(c) <= apart:
        return
    sizes = [len(w) + 1 for w in words]
    weights = np.repeat(np.array(list(words.values()), dtype=float), sizes)
    keys = c[:-apart] << 21 | c[apart:]
    if apart > 1:  # within one word
        word = np.repeat(np.arange(len(words)), sizes)
        inside = word[: len(keys)] == np.concatenate([word, [-1]])[apart - 1 :][: len(keys)]
        inside[0] &= c[0] != 32
        keys, weights = keys[inside], weights[: len(keys)][inside]
    keys, place = np.unique(keys, return_inverse=True)
    for k, n in zip(keys.tolist(), np.bincount(place, weights=weights)):
        yield chr(k >> 21), chr(k & 0x1FFFFF), int(n)


class _Odd(dict):
    """Which tokens may have been decoded wrongly, each looked at once."""

    def __missing__(self, token: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        self[token] = got = odd(token) or "??" in token and _LOST.search(token) is not None
        return got


_SCAN = "what string, source string, a string, b string, n long, field_name string, record_id long, token string"


def scanned(rows: DataFrame) -> DataFrame:
    """All that is learnt from texts, in one pass over (field_name, record_id, source, value), written once.

    what = token: field_name, record_id, source and token of every token that may have been decoded wrongly. Else a, b,
    n: bigrams of bytes, of letters as bytes and of characters (utf8, legacy, double, char), and of odd tokens per
    source (odd). Pairs three apart are counted as well, of bytes (utf8-3) and of odd tokens (odd-3): most scripts here
    take three bytes a letter, so these pairs tell which letters follow each other. Words are counted before their
    bigrams are, in every batch.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        sums: dict[str, np.ndarray] = {}
        is_odd = _Odd()
        for pdf in batches:
            by_source: dict[str, Counter] = {}
            held: set[tuple[str, int, str, str]] = set()
            every: Counter = Counter()
            for f, i, s, v in zip(pdf["field_name"], pdf["record_id"], pdf["source"], pdf["value"]):
                parts = tokens(v)
                every.update(parts)
                if not v.isascii() and _ODD.search(v) or "???" in v:  # no other text has such tokens
                    strange = list(compress(parts, map(is_odd.__getitem__, parts)))
                    held.update((f, i, s, w) for w in strange)
                    by_source.setdefault(s, Counter()).update(w for w in strange if odd(w))
            every.pop("", None)
            yield from _odd_pairs(by_source)
            for w in [w for w in every if not w.isascii() and is_odd[w] and (_LOST.search(w) or foreign(w) or len(_scripts(w, "L")) > 1)]:
                del every[w]
            _count_bytes(every, sums)
            for a, b, n in _pairs(every, True):
                total["char", None, a, b] += n
            yield pd.DataFrame([("token", s, None, None, 1, f, i, w) for f, i, s, w in sorted(held)], columns=[x.split()[0] for x in _SCAN.split(", ")])
            if len(total) > 500_000:
                yield _counts(total)
                total = Counter()
        for what, sum_of in sums.items():
            at = np.flatnonzero(sum_of)
            total.update({(what, None, chr(i >> 8), chr(i & 255)): int(n) for i, n in zip(at.tolist(), sum_of[at])})
        yield _counts(total)

    return cut(rows.select("field_name", "record_id", "source", "value").mapInPandas(read, _SCAN))


def _counts(total: Counter) -> pd.DataFrame:
    return pd.DataFrame([(*k, n, None, None, None) for k, n in total.items()], columns=[x.split()[0] for x in _SCAN.split(", ")])


def _letters(codes: np.ndarray) -> np.ndarray:
    own, place = np.unique(codes, return_inverse=True)
    return np.array(list(map(chr, own.tolist())), dtype=object)[place]


def _odd_pairs(by_source: dict[str, Counter]) -> Iterator[pd.DataFrame]:
    """Bigrams of every source's odd tokens, one of the two no ASCII, and pairs three apart, neither of them ASCII."""
    words = [(k, w, n) for k, own in enumerate(by_source.values()) for w, n in own.items()]
    if not words:
        return
    names = np.array(list(by_source), dtype=object)
    c = np.frombuffer((" " + " ".join(w for _, w, _ in words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), [len(w) + 1 for _, w, _ in words])  # a blank belongs to the word after it
    owner = np.array([k for k, _, _ in words])[word] << 42
    weights = np.array([n for _, _, n in words], dtype=float)[word]
    for what, apart in (("odd", 1), ("odd-3", 3)):
        a, b = c[:-apart], c[apart:]
        at = np.flatnonzero((a >= 128) | (b >= 128) if apart == 1 else (a >= 128) & (b >= 128))
        if apart > 1:
            at = at[word[at] == word[at + apart - 1]]
        keys, place = np.unique(owner[at] | a[at] << 21 | b[at], return_inverse=True)
        if len(keys):
            n = np.bincount(place, weights=weights[at]).astype(np.int64)
            rows = {"what": what, "source": names[keys >> 42], "a": _letters(keys >> 21 & 0x1FFFFF), "b": _letters(keys & 0x1FFFFF), "n": n}
            yield pd.DataFrame(rows | {"field_name": None, "record_id": None, "token": None})


def _count_bytes(every: Counter, sums: dict[str, np.ndarray]) -> None:
    """Add the bigrams of the bytes of words in all forms, by the number first byte * 256 + second byte."""

    def add(what: str, codes: np.ndarray, weights: np.ndarray) -> None:
        sums[what] = sums.get(what, 0) + np.bincount(codes, weights=weights, minlength=65536)

    chosen = {"legacy": [w for w in every if w.isascii() or _WESTERN.fullmatch(w)], "double": [w for w in every if not w.isascii() and _HAN.search(w)], "utf8": list(every)}
    for what, page in (("utf8", "utf-8"), ("legacy", "cp1252"), ("double", "gbk")):
        parts = chosen[what]
        if not parts:
            continue
        flat = np.frombuffer(f" {' '.join(parts)} ".encode(page, "ignore"), dtype=np.uint8).astype(np.int64)
        each = np.array([every[w] for w in parts], dtype=float)[np.cumsum(flat[:-1] == 32) - 1]  # no byte of a word is a blank
        add(what, flat[:-1] * 256 + flat[1:], each)
        if what == "utf8":
            high = np.flatnonzero((flat[:-3] >= 128) & (flat[3:] >= 128) & (flat[1:-2] != 32) & (flat[2:-1] != 32))
            add("utf8-3", flat[high] * 256 + flat[high + 3], each[high])


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    out = np.zeros((256, 256))
    if len(rows):
        out[rows["a"].map(ord).to_numpy(), rows["b"].map(ord).to_numpy()] = rows["n"]
    return out


class Language:
    """Bigrams of the corpus: of its bytes under both forms and of its characters."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.joint = {}
        for form in FORMS:
            m = _matrix(rows[rows["what"] == form])
            if form == "double":
                self.double = m
            m = (m + 1e-7) / (m.sum() + 1e-7 * 65536)
            if form == "utf8":  # what UTF-8 allows, though no text of the corpus has it yet
                allowed = np.zeros((256, 256))
                allowed[0xC2:0xF5, 0x80:0xC0] = allowed[0x80:0xC0, 0x80:0xC0] = allowed[0x80:0xC0, 0xC2:0xF5] = 1
                m = 0.99 * m + 0.01 * allowed / allowed.sum()
            self.joint[form] = m
        self.joint |= {f"{form}-t": np.ascontiguousarray(m.T) for form, m in self.joint.items()}  # by the second byte
        m = _matrix(rows[rows["what"] == "utf8-3"])
        self.joint["utf8-3"] = (m + 1e-7) / (m.sum() + 1e-7 * 65536)
        chars = rows[rows["what"] == "char"]
        self.char = {a + b: float(n) for a, b, n in zip(chars["a"], chars["b"], chars["n"])}
        self.first: Counter = Counter()
        for k, n in self.char.items():
            self.first[k[0]] += n
        self.total = sum(self.first.values())
        self.scored: dict[str, float] = {}

    def score(self, word: str) -> float:
        """Mean log probability of a word's bigrams; kept, as words come again from other sources."""
        got = self.scored.get(word)
        if got is not None:
            return got
        if len(self.scored) > 200_000:
            self.scored.clear()
        w = f" {''.join(map(kind, word))} "
        total = sum(math.log((self.char.get(a + b, 0.0) + 0.05) / (self.first.get(a, 0.0) + 20.0)) for a, b in zip(w, w[1:]))
        self.scored[word] = got = total / (len(w) - 1)
        return got

    def reads_double(self, raw: bytes) -> str | None:
        """The Chinese text of bytes, or None unless they hold two letters and all of theirs occur in the language."""
        try:
            text = raw.decode("gbk")
        except UnicodeDecodeError:
            return None
        han = [c.encode("gbk") for c in text if not c.isascii()]
        return text if len(han) > 1 and _HAN.search(text) and all(self.double[c[0], c[1]] >= 2 for c in han) else None

    def reads(self, word: str, least: float = 2.0) -> bool:
        """Whether all bigrams round unusual characters of a word occur in the language."""
        w = f" {''.join(map(kind, word))} "
        return all(a.isascii() and b.isascii() or self.char.get(a + b, 0.0) >= least for a, b in zip(w, w[1:]))


@lru_cache(maxsize=1)
def _coded() -> dict[str, np.ndarray]:
    """Character to byte of every page as an array over the code points below 0x3000; -1 where a page has none."""
    out = {}
    for page, table in pages().items():
        codes = np.full(0x3000, -1, np.int64)
        codes[:128] = np.arange(128)
        for b, c in table.items():
            if ord(c) < 0x3000:
                codes[ord(c)] = b
        out[page] = codes
    return out


class Bigrams:
    """Pairs of characters of one source's odd tokens, numbered over its unusual characters."""

    def __init__(self, rows: pd.DataFrame, points: np.ndarray | None = None) -> None:
        a = np.fromiter(map(ord, rows["a"]), np.int64, len(rows))
        b = np.fromiter(map(ord, rows["b"]), np.int64, len(rows))
        self.n = rows["n"].to_numpy(dtype=float)
        self.a, self.b = a, b
        if points is None:
            points = np.unique(np.concatenate([a, b]))
            points = points[points >= 128]
        self.points = points
        self.at_a, self.at_b = np.searchsorted(self.points, a), np.searchsorted(self.points, b)
        self.high_a, self.high_b = a >= 128, b >= 128

    def seen(self) -> np.ndarray:
        """How often each unusual character stands in a pair."""
        return np.bincount(self.at_a[self.high_a], weights=self.n[self.high_a], minlength=len(self.points)) + np.bincount(self.at_b[self.high_b], weights=self.n[self.high_b], minlength=len(self.points))

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        """Counts of pairs of two unusual characters, only those of ``rows``."""
        out = np.zeros((len(self.points), len(self.points)))
        rows = rows & self.high_a & self.high_b
        out[self.at_a[rows], self.at_b[rows]] = self.n[rows]
        return out


def _ranked(joint: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Where a cipher without a page starts: characters stand for bytes of about their own frequency."""
    byte = joint[128:].sum(axis=1) + joint[:, 128:].sum(axis=0)
    f, g = np.log(byte / byte.sum() + 1e-6), np.log(seen / seen.sum() + 1e-6)
    t = np.exp(-((f[:, None] - g[None, :]) ** 2))
    return t / t.sum(axis=1, keepdims=True)


def learn(rows: pd.DataFrame, joint: dict[str, np.ndarray], clean: dict[str, float], far: pd.DataFrame | None = None, rounds: int = 3, free_rounds: int = 4) -> list[tuple[str, str, str, int, float]]:
    """Mappings of one source: (page a cipher starts at or "", form, character, byte, weight), entries of the page left out.

    ``rows``: a, b, n, bigrams of its odd tokens; ``far``: pairs of characters three apart. Every cipher is a component of a mixture, beside clean text. First
    the weights of the pages are estimated as they are; a cipher with less than a thousandth of an expected bigram has explained
    none. Then weights and the bytes of all characters that a page lacks are estimated together: how often such a
    character stands for a byte is expected from the bigrams it occurs in. What is left without explanation, if there
    are dozens of such bigrams, starts one more cipher, all of whose characters are free, from character ranks alone.
    """
    if not len(rows):
        return []
    big = Bigrams(rows)
    n, points = big.n, big.points
    total = max(sum(clean.values()), 1.0)
    kinds = {c: kind(c) for c in {*rows["a"], *rows["b"]}}
    met = np.array([clean.get(kinds[a] + kinds[b], 0.0) for a, b in zip(rows["a"], rows["b"])])
    ground = (met + 0.01) / total
    free = _paged(points)
    names, codes, listed = [], {}, []
    for page, table in _coded().items():
        code = lambda x: np.where(x < 0x3000, table[np.minimum(x, 0x2FFF)], -1)  # noqa: B023, E731
        a, b = code(big.a), code(big.b)
        sure = (a >= 0) & (b >= 0)
        codes[page] = a, b
        for form in FORMS:
            if form == "utf8" and not ((a >= 0xC2) & ((b >= 0x80) & (b < 0xC0) | (b < 0))).any() or form == "legacy" and (page in ("cp1252", "latin_1", "cp1254") or not sure.any()):
                continue
            x = np.full(len(n), 1e-12)
            x[sure] = joint[form][a[sure], b[sure]]
            names.append((page, form))
            listed.append(x)
    like = np.array(listed).reshape(len(names), len(n))
    weights = np.full(len(names), 0.3 / max(len(names), 1))

    def mix() -> np.ndarray:
        return ground * max(1 - weights.sum(), 0.02) + weights @ like

    def weigh() -> None:
        nonlocal weights
        weights = (like @ (n / mix())) * weights / n.sum()
        weights[weights * n.sum() < 0.001] = 0.0
        weights *= min(1.0, 0.98 / max(weights.sum(), 1e-300))

    for _ in range(rounds):
        weigh()
    learnt: dict[tuple[str, str], dict[str, int]] = {k: {} for k in names}
    for r in np.flatnonzero(weights * n.sum() >= 1):
        a, b = codes[names[r][0]]
        right = np.flatnonzero((a >= 0) & (b < 0) & big.high_b & free[np.minimum(big.at_b, len(points) - 1)])
        left = np.flatnonzero((a < 0) & (b >= 0) & big.high_a & free[np.minimum(big.at_a, len(points) - 1)])
        at = np.concatenate([right, left])
        if not len(at):
            continue
        own = np.concatenate([joint[names[r][1]][a[right], 128:], joint[f"{names[r][1]}-t"][b[left], 128:]])
        letters, place = np.unique(np.concatenate([big.at_b[right], big.at_a[left]]), return_inverse=True)
        member = np.zeros((len(letters), len(at)))
        member[place, np.arange(len(at))] = 1
        theta = np.full((len(letters), 128), 1 / 128)
        rest = mix()[at] - weights[r] * like[r, at]
        for _ in range(free_rounds):
            part = own * theta[place]
            got = part.sum(axis=1) + 1e-12
            counts = member @ (part * (weights[r] * n[at] / (rest + weights[r] * got))[:, None])
            theta = (counts + 1e-3) / (counts + 1e-3).sum(axis=1, keepdims=True)
        like[r, at] = got
        seen = member @ n[at]
        control = points[letters] < 0xA0
        for i in np.flatnonzero((theta.max(axis=1) > 0.3) & (control | (counts.sum(axis=1) > np.maximum(3.0, 0.5 * seen)))):
            learnt[names[r]][chr(points[letters[i]])] = int(theta[i].argmax()) + 128
    for _ in range(2):
        weigh()
    weight = {k: float(w) for k, w in zip(names, weights) if w > 0}
    out = [(*k, "", 0, w) for k, w in weight.items()]  # the page itself, which every task knows
    if far is not None:
        far_big = Bigrams(far, points)
        known = lambda some: some[big.at_a.clip(max=len(points) - 1)] & some[big.at_b.clip(max=len(points) - 1)]
        known_far = lambda some: some[far_big.at_a] & some[far_big.at_b]
        whole = mix()
        held = {k: np.where(points < 0x3000, _coded()[k[0]][np.minimum(points, 0x2FFF)], -1) for k in weight if k[1] == "utf8"}
        if held:
            # letters that no page at work has: the heaviest cipher starts at its page, and all its characters are free
            rows_of = [i for i, k in enumerate(names) if k in held]
            by_page = n * (weights[rows_of] @ like[rows_of]) / whole
            explained = np.bincount(np.concatenate([big.at_a[big.high_a], big.at_b[big.high_b]]), weights=np.concatenate([by_page[big.high_a], by_page[big.high_b]]), minlength=len(points))
            k = max(held, key=weight.get)
            met_by = np.any([codes_of >= 0 for x, codes_of in held.items() if weight[x] >= 0.02] + [held[k] >= 0], axis=0)
            lacking = free & (points >= 0xA0) & ~met_by & (explained > 0.9 * big.seen())
            if big.seen()[lacking].sum() >= 40:
                mine = lacking | free & (held[k] >= 128)
                start = _ranked(joint["utf8"], big.seen() + 1e-3)
                for i in np.flatnonzero(mine & ~lacking):
                    start[:, i] = 1e-4
                    start[held[k][i] - 128] = 1e-4
                    start[held[k][i] - 128, i] = 1.0
                made = _solve(big.matrix(known(mine)), far_big.matrix(known_far(mine)), joint, start / start.sum(axis=1, keepdims=True))
                for letters in learnt.values():
                    for c in points[lacking]:
                        letters.pop(chr(c), None)
                learnt[k].update({c: byte for c, byte in _sure(made, points).items() if lacking[np.searchsorted(points, ord(c))]})
        # what nothing explains: one more cipher, from ranks alone
        elsewhere = np.maximum(met - n, 0.0)  # a pair that only this source has is no language
        dark = (elsewhere < 1) & big.high_a & big.high_b & (weights @ like < 2 * (elsewhere + 0.01) / total)
        share = np.bincount(np.concatenate([big.at_a[dark], big.at_b[dark]]), weights=np.concatenate([n[dark], n[dark]]), minlength=len(points))
        mine = free & (share > 0.5 * big.seen())
        if n[dark & known(mine)].sum() >= 40:
            near, apart = big.matrix(known(mine)), far_big.matrix(known_far(mine))
            made = _solve(near, apart, joint, _ranked(joint["utf8"], share + 1e-3))
            if _fit(near, made, joint["utf8"]) > -1.0:
                w = float(n[dark].sum() / n.sum())
                out += [("", "utf8", "", 0, w), *(("", "utf8", c, byte, w) for c, byte in _sure(made, points).items())]
    return out + [(*k, c, byte, float(weight[k])) for k, letters in learnt.items() if k in weight for c, byte in letters.items()]


def _fit(near: np.ndarray, counts: np.ndarray, joint: np.ndarray) -> float:
    """Mean log ratio of the probability a cipher gives to pairs of characters to their share: near 0 if it explains them."""
    t = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
    like = t.T @ joint[128:, 128:] @ t
    at = near > 0
    return float((near[at] * np.log((like[at] + 1e-9) / like.sum() / (near[at] / near.sum()))).sum() / near.sum())


def _sure(counts: np.ndarray, points: np.ndarray) -> dict[str, int]:
    """Characters with the byte that most of their expected occurrences stand for."""
    total = counts.sum(axis=0)
    return {chr(points[i]): int(counts[:, i].argmax()) + 128 for i in np.flatnonzero((total > 1) & (counts.max(axis=0) > 0.5 * total))}


def _solve(near: np.ndarray, apart: np.ndarray, joint: dict[str, np.ndarray], start: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Expected numbers of bytes by characters of a cipher all of whose characters are free.

    ``near`` and ``apart``: counts of pairs of characters one and three apart. Emissions of characters by bytes are
    re-estimated, first from neighbours, which tell the classes of bytes, then from both, which tell the letters.
    """
    t = start
    j1, j3 = joint["utf8"][128:, 128:], joint["utf8-3"][128:, 128:]
    counts = t
    for turn in range(3 * rounds):
        counts = np.zeros_like(t)
        for j, seen in ((j1, near), (j3, apart)) if turn >= rounds else ((j1, near),):
            r = seen / (t.T @ j @ t + 1e-300)
            counts += t * (j @ t @ r.T + j.T @ t @ r)
        t = counts + 1e-6
        if turn == rounds - 1:
            t = 0.9 * t / t.sum(axis=1, keepdims=True) + 0.1 * start
        t /= t.sum(axis=1, keepdims=True)
    return counts


def _paged(points: np.ndarray) -> np.ndarray:
    """Which characters a single-byte page may hold: none of scripts of thousands of letters, nor of Indic ones."""
    return (points < 0x0900) | (points >= 0x0E00) & (points < 0x2E80) | (points >= 0xE000) & (points < 0xFF00)


def _bytes_of(word: str, table: dict[int, int]) -> bytes | None:
    """The bytes a table turns a word into, or None if some character has none."""
    try:
        return word.translate(table).encode("latin-1")
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> tuple[str, str]:
    """First letter of a character's category and first word of its name; no category for ASCII that is no letter."""
    return "" if c.isascii() and not c.isalpha() else unicodedata.category(c)[0], unicodedata.name(c, "?").split(" ")[0]


def _scripts(word: str, categories: str = "LS") -> set[str]:
    return {name for kind_of, name in map(_script, word) if kind_of and kind_of in categories}


def decrypt(word: str, tables: dict[tuple[str, str], dict[int, int]], language: Language) -> tuple[bool, str]:
    """Whether a token was decoded wrongly, and the token restored as far as it can be."""
    if _LOST.search(word):
        return True, word
    runs = max(map(len, _HIGH.findall(word)), default=0)
    rare = 20 + 2e-6 * language.total
    mixed = len(_scripts(word)) > 1 or all(language.first.get(c, 0) < rare for c in word if c.isalpha())
    if runs < 2 and not mixed:
        return False, word
    high = {ord(c) for c in word if not c.isascii()}
    alone = tables.get(("", "utf8"))
    # the letters of a cipher without a page are in no other source, so that they tell nothing of the language
    own = -99.0 if alone and sum(ord(c) in alone for c in word) > 0.5 * sum(ord(c) >= 128 for c in word) else language.score(word)
    best, text, wrong = own, word, False
    for (page, form), table in tables.items():
        if form == "utf8":
            if runs < 2 or len(high & table.keys()) < 1:
                continue
            changed = False

            def fix(m: re.Match) -> str:
                nonlocal changed
                raw = _bytes_of(m.group(), table)
                if raw is None or len(raw) < 2:
                    return m.group()
                try:
                    out = raw.decode("utf-8")
                except UnicodeDecodeError:
                    if not (raw[0] >= 0xC2 and 0x80 <= raw[1] < 0xC0):
                        return m.group()
                    out = raw.decode("utf-8", "ignore")
                    if 2 * len(out.encode()) < len(raw) and len(raw) > 3:
                        return m.group()
                changed = True
                return out

            made = _HIGH.sub(fix, word)
            if not changed:
                continue
        elif form == "double":
            if runs < 4 and len(high) < 2:
                continue
            made = word
            for part in (word, *_HIGH.findall(word)):
                raw = _bytes_of(part, table)
                got = language.reads_double(raw) if raw is not None and len(raw) > 3 else None
                if got is not None:
                    made = made.replace(part, got, 1)
                    if part == word:
                        break
            if made != word:
                return True, made
            continue
        else:
            if not mixed or not high <= table.keys():
                continue
            made = word.translate({c: _WEST.get(table[c], chr(table[c])) for c in high})
            if made == word or not language.reads(made):
                continue
        again = made
        if form == "utf8" and odd(made):  # decoded wrongly twice
            again = max([made, *decrypt_once(made, tables)], key=language.score)
        score = language.score(again)
        if score > best:
            best, text, wrong = score, again, True
            if language.reads(again):  # the likeliest cipher that gives plain text
                break
    return wrong, text


def decrypt_once(word: str, tables: dict[tuple[str, str], dict[int, int]]) -> list[str]:
    """Every form a token takes when a table turns all of its unusual runs into UTF-8."""
    out = []
    for (_, form), table in tables.items():
        if form == "utf8":
            raw = _bytes_of(word, table)
            if raw is not None:
                try:
                    out.append(raw.decode("utf-8"))
                except UnicodeDecodeError:
                    pass
    return out


_WEST = {b: c for b, c in ((b, bytes([b]).decode("cp1252", "ignore")) for b in range(128, 256)) if c}


def wrong_tokens(scan: DataFrame) -> DataFrame:
    """source, token, restored of every token that was decoded wrongly, from what ``scanned`` gives."""
    counted = scan.where("what <> 'token'").groupBy("what", "source", "a", "b").agg(F.sum("n").alias("n"))
    shared = counted.where("what not in ('odd', 'odd-3')").toPandas()  # 4 x 65536 byte pairs and the characters' pairs, bounded by the alphabets
    language = Language(shared)
    joint, clean = language.joint, language.char

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        far = pdf[pdf["what"] == "odd-3"]
        found = learn(pdf[pdf["what"] == "odd"], joint, clean, far if len(far) else None)
        return pd.DataFrame([(pdf["source"].iloc[0], json.dumps(sorted(found, key=lambda x: -x[4])))], columns=["source", "mapping"])

    # the mapping goes with every token of its source as one string, which is read once a source
    tables = counted.where("what in ('odd', 'odd-3')").groupBy("source").applyInPandas(fit, "source string, mapping string")
    strange = scan.where("what = 'token'").groupBy("source", "token").agg(F.lit(1)).select("source", "token")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, dict] = {}
        for pdf in batches:
            out = []
            for source, token, mapping in zip(pdf["source"], pdf["token"], pdf["mapping"]):
                own = kept.get(source)
                if own is None:
                    own = {}
                    for page, form, letter, byte, _ in json.loads(mapping) if mapping else ():
                        if (page, form) not in own:
                            own[page, form] = dict(_backward().get(page, ()))
                        if letter:
                            own[page, form][ord(letter)] = byte
                    if len(kept) > 1000:
                        kept.clear()
                    kept[source] = own
                wrong, restored = decrypt(token, own, language)
                if wrong:
                    out.append((source, token, restored))
            yield pd.DataFrame(out, columns=["source", "token", "restored"])

    return strange.join(tables, "source", "left").mapInPandas(solve, "source string, token string, restored string")


def records(df: DataFrame) -> DataFrame:
    """field_name, record_id, tokens with their restored form, of every record with text decoded wrongly.

    ``df``: field_name, record_id, source, value. Repeated rows count once; null values are none.
    """
    scan = scanned(df.select("field_name", "record_id", F.coalesce("source", F.lit("")).alias("source"), "value").where("value is not null"))
    held = scan.where("what = 'token'").select("field_name", "record_id", "source", "token")
    return held.join(wrong_tokens(scan), ["source", "token"]).groupBy("field_name", "record_id").agg(F.collect_set(F.struct("token", "restored")).alias("tokens"))


def restored(df: DataFrame, damaged: DataFrame) -> DataFrame:
    """field_name, record_id, value: the values of the damaged records with every restorable token restored."""

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for value, todo in zip(pdf["value"], pdf["tokens"]):
                table = {x["token"]: x["restored"] for x in todo}
                out.append("".join(table.get(w, w) for w in re.split("([ \t\n\r\f\v]+)", value)))
            yield pdf[["field_name", "record_id"]].assign(value=out)

    rows = df.select("field_name", "record_id", "value").where("value is not null").distinct()
    return rows.join(damaged, ["field_name", "record_id"]).mapInPandas(mend, "field_name string, record_id long, value string")
