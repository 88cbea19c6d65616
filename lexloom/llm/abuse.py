"""Scores for abusive, hateful and sexual content.

A bidirectional gated recurrent network with attention pooling reads all overlapping windows of a text. A word enters
as the sum of the vectors of its character n-grams and of itself, after spelling tricks (digits for letters, doubled
or spread letters) are undone; masks stay as wildcards. The network is trained here, in numpy, on windows of reviewed
documents. Reviews concern whole documents and err, so the windows that a positive review is about are inferred.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.lookalikes import TO_LATIN

#: Every span of up to WINDOW - STRIDE + 1 words stands whole in some window; a longer one may be cut.
WINDOW, STRIDE = 24, 8
HIDDEN, WIDTH, BUCKETS = 14, 20, 1 << 13
#: Windows that pass through the network at once.
BATCH = 1024
#: Rows of parameters that are stepped at once, so that they stay in the cache.
BLOCK = 1024

#: Bounds of what is fitted on: reviewed documents and windows of them.
MOST_DOCUMENTS, MOST_WINDOWS = 20_000, 24_000

_DRAWN = str.maketrans(TO_LATIN | {"\xad": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": ""})
_VEIL = re.compile("[" + "".join(map(chr, _DRAWN)) + "]")
_SPREAD = re.compile(r"[^\W\d_](?:[-_][^\W_]){3,}")
#: What stands between words, besides blanks.
_BETWEEN = ".,;:?()[]{}“”\"«»।॥…—–/。，！？（）：；"
_LEET = str.maketrans("0134579@$!|", "oieastgasil")
_HARD = re.compile(r"[a-zà-ÿ]")
_TRICK = re.compile(r"[0-9@$!|]")
_RUN = re.compile(r"(.)\1+")
_CJK = re.compile("([㐀-鿿])")


def words(text: str) -> list[str]:
    """Words of a text in small letters; letters spread one by one are put together."""
    t = text.lower()
    if not t.isascii() and _VEIL.search(t):
        t = t.translate(_DRAWN)
    for c in _BETWEEN:  # many times as fast as an expression that finds the words
        t = t.replace(c, " ")
    out = t.split()
    sizes = list(map(len, out))
    if sizes.count(1) > 3 and b"\1\1\1\1" in bytes(map((1).__eq__, sizes)):
        made: list[str] = []
        row: list[str] = []
        for w in [*out, ""]:
            if len(w) == 1 and w.isalnum() and not "㐀" <= w <= "鿿":
                row.append(w)
                continue
            made += ["".join(row)] if len(row) > 3 else row
            row = []
            made.append(w)
        out = made[:-1]
    if not t.isascii() and _CJK.search(t):
        out = _CJK.sub(r" \1 ", " ".join(out)).split()
    return out


def normal(word: str) -> str:
    """A word without tricks of spelling; numbers are all alike."""
    w = word.strip("!'’‘-_")
    if not w:
        return "!" if "!" in word else "-"
    if ("-" in w or "_" in w) and _SPREAD.fullmatch(w):
        w = w.replace("-", "").replace("_", "")
    if _TRICK.search(w):
        if not _HARD.search(w):
            return "#"
        w = w.translate(_LEET)
    return _RUN.sub(r"\1", w)


def _crcs(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """CRC-32 of many slices of one string of bytes at once."""
    table = _crc_step()
    crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
    for k in range(int((last - first).max()) if len(first) else 0):
        at = first + k
        alive = at < last
        step = table[(crc ^ raw[np.minimum(at, len(raw) - 1)]) & 0xFF] ^ (crc >> np.uint32(8))
        crc = step if alive.all() else np.where(alive, step, crc)
    return ~crc


@lru_cache(maxsize=1)
def _crc_step() -> np.ndarray:
    """What one byte makes of the register, by the polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


def slots(word: str) -> list[int]:
    """Slots of a word (twice) and of its pieces of two to four letters, with marks at both ends."""
    return slots_of([word])[0].tolist()


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of many words, one after the other, and how many each has."""
    marked = [f"<{w}>" for w in words]
    raw = np.frombuffer("".join(marked).encode("utf-8", "surrogatepass") + b"\0", np.uint8)
    opens = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where letters begin
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.cumsum(size) - size
    owner, first, last = [np.arange(len(words))] * 2, [opens[start]] * 2, [opens[start + size]] * 2
    for n in (2, 3, 4):
        many = np.maximum(size - n + 1, 0)
        who = np.repeat(np.arange(len(words)), many)
        at = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + start[who]
        owner.append(who)
        first.append(opens[at])
        last.append(opens[at + n])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    found = np.concatenate([_crcs(raw, f, l) for f, l in zip(first, last)]) % BUCKETS
    return found[order].astype(np.int64), np.bincount(owner, minlength=len(words))


class Bags:
    """Slots of numbered words, one after the other."""

    def __init__(self, listed: list[list[int]] = ()) -> None:
        self.size = np.fromiter(map(len, listed), np.int64, len(listed))
        self.flat = np.fromiter((x for l in listed for x in l), np.int64, int(self.size.sum()))
        self.first = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return len(self.size)

    def add(self, words: list[str]) -> None:
        flat, size = slots_of(words)
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.first = np.cumsum(self.size) - self.size

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of some words and how many each has."""
        size = self.size[words]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[words] - (ends - size), size)], size


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows of n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


_STEPS = np.arange(WINDOW)


def _sums(rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The sum of each group's rows; groups of as many rows stand together and are summed at once."""
    many = np.bincount(group, minlength=groups)
    by_size = np.argsort(many, kind="stable")
    rank = np.empty(groups, np.min_scalar_type(groups))  # few bits are sorted by digits
    rank[by_size] = np.arange(groups)
    order = np.argsort(rank[group], kind="stable")
    held = rows.take(order, axis=0)
    sums, at, done = np.zeros((groups, rows.shape[1]), rows.dtype), 0, 0
    for size, alike in zip(*np.unique(many, return_counts=True)):
        if size:
            np.einsum("nsd->nd", held[at : at + size * alike].reshape(alike, size, -1), out=sums[done : done + alike])
        at, done = at + size * alike, done + alike
    out = np.empty_like(sums)
    out[by_size] = sums
    return out


class Network:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": (r.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32), "wo": g(2 * HIDDEN), "bo": np.zeros(1, np.float32), "wa": g(2 * HIDDEN)}
        for d in "fb":
            self.p |= {f"W{d}": g(WIDTH, 3 * HIDDEN), f"U{d}": g(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.rooms: dict[tuple[str, str], np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write into, kept from call to call: fresh memory costs more than what is computed in it."""
        kind_of, size = self.p["E"].dtype, int(np.prod(shape))
        held = self.rooms.get((name, kind_of.char))
        if held is None or held.size < size:
            held = self.rooms[name, kind_of.char] = np.empty(size, kind_of)
        return held[:size].reshape(shape)

    def project(self, bags: Bags | list[list[int]], since: int = 0) -> np.ndarray:
        """Inputs to the gates of both directions for words given by their slots, from a number on."""
        bags = bags if isinstance(bags, Bags) else Bags(bags)
        parts = []
        for at in range(since, len(bags), 4096):
            flat, size = bags.of(np.arange(at, min(at + 4096, len(bags))))
            parts.append(np.add.reduceat(self.p["E"][flat], np.cumsum(size) - size, axis=0) / np.sqrt(size.astype(np.float32))[:, None])
        e = np.concatenate(parts) if parts else np.zeros((0, WIDTH), self.p["E"].dtype)
        return np.concatenate([e @ self.p["Wf"] + self.p["cf"], e @ self.p["Wb"] + self.p["cb"]], axis=1)

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 0.5 * (np.tanh(0.5 * x) + 1)

    def run(self, px: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities of windows, step by step; px: windows x words x gates, mask: windows x words."""
        n, t, _ = px.shape
        h_all = np.zeros((n, t, 2 * HIDDEN), px.dtype)
        for d, off in (("f", 0), ("b", 3 * HIDDEN)):
            u = self.p[f"U{d}"]
            h = np.zeros((n, HIDDEN), px.dtype)
            for k in range(t) if d == "f" else range(t - 1, -1, -1):
                x = px[:, k, off : off + 3 * HIDDEN]
                zr = self._sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
                h = h + mask[:, k : k + 1] * z * (c - h)
                h_all[:, k, HIDDEN * (d == "b") : HIDDEN * (1 + (d == "b"))] = h
        score = h_all @ self.p["wa"] + (mask - 1) * 1e4
        a = np.exp(score - score.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        return self._sigmoid(np.einsum("nt,nth->nh", a, h_all) @ self.p["wo"] + self.p["bo"])

    @staticmethod
    def halves(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Projected words as ``read`` takes them: gates x words x units of either direction, times what its exponentials want."""
        parts = np.empty((2, 3, len(table), HIDDEN), np.float32)
        np.multiply(table.reshape(-1, 2, 3, HIDDEN).transpose(1, 2, 0, 3), np.array([-1, -1, -2], np.float32)[:, None, None], out=parts)
        return parts[0], parts[1]

    def read(self, forward: np.ndarray, backward: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The probabilities of ``run`` for windows given by rows of the halves of a table of projected words."""
        index, mask = index.T, mask.T
        t, n = index.shape
        one = HIDDEN  # both directions run side by side, the second one backwards
        recur = np.stack([[-self.p[f"U{d}"][:, i * one : (i + 1) * one] for i in range(2)] for d in "fb"])
        cand = np.stack([-2 * self.p[f"U{d}"][:, 2 * one :] for d in "fb"])
        x, gates = self.room("words", 2, 3, n, one), self.room("gates", 2, 2, n, one)
        c, moved = self.room("cand", 2, n, one), self.room("reset", 2, n, one)
        heads = np.stack([np.stack([self.p[name][i * one : (i + 1) * one] for name in ("wa", "wo")], axis=1) for i in range(2)])
        both = self.room("heads", 2, t, n, 2)  # what attention and score make of each direction's states
        h = np.zeros((2, n, one), np.float32)
        full = bool(mask.all())
        update, reset = gates[:, 0], gates[:, 1]
        with np.errstate(over="ignore"):  # an exponential without bound is a gate that is shut
            for k in range(t):
                for i in range(3):
                    forward[i].take(index[k], axis=0, out=x[0, i], mode="clip")
                    backward[i].take(index[t - 1 - k], axis=0, out=x[1, i], mode="clip")
                np.matmul(h[:, None], recur, out=gates)
                gates += x[:, :2]
                np.exp(gates, out=gates)
                gates += 1
                np.divide(1, gates, out=gates)
                np.multiply(reset, h, out=moved)
                np.matmul(moved, cand, out=c)
                c += x[:, 2]
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                c -= h
                c *= update
                if not full:
                    c[0] *= mask[k][:, None]
                    c[1] *= mask[t - 1 - k][:, None]
                h += c
                both[0, k], both[1, t - 1 - k] = h @ heads
        both = both[0] + both[1]
        score = both[:, :, 0] + (mask - 1) * 1e4
        a = np.exp(score - score.max(axis=0))
        a /= a.sum(axis=0)
        return self._sigmoid((both[:, :, 1] * a).sum(axis=0) + self.p["bo"])

    def _blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Recurrent weights of both directions side by side: of the gates (update, reset) and of the candidate."""
        both = 2 * HIDDEN
        recur, cand = np.zeros((both, 2 * both), self.p["Uf"].dtype), np.zeros((both, both), self.p["Uf"].dtype)
        for d, u in enumerate((self.p["Uf"], self.p["Ub"])):
            own = slice(d * HIDDEN, (d + 1) * HIDDEN)
            recur[own, own] = u[:, :HIDDEN]
            recur[own, both + d * HIDDEN : both + (d + 1) * HIDDEN] = u[:, HIDDEN : 2 * HIDDEN]
            cand[own, own] = u[:, 2 * HIDDEN :]
        return recur, cand

    def gradients(self, index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, bags: Bags | list[list[int]]) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross-entropy; index: windows x words into bags.

        Both directions run side by side, the second one backwards.
        """
        bags = bags if isinstance(bags, Bags) else Bags(bags)
        used, inverse = np.unique(index, return_inverse=True)
        inverse = inverse.reshape(index.shape)
        by_size = np.argsort(bags.size[used], kind="stable")  # words of as many slots stand together and are summed at once
        used = used[by_size]
        rank = np.empty(len(used), np.int64)
        rank[by_size] = np.arange(len(used))
        inverse = rank[inverse]
        flat, sizes = bags.of(used)
        roots = np.sqrt(sizes.astype(np.float32))
        held = self.p["E"].take(flat, axis=0, out=self.room("slots", len(flat), WIDTH), mode="clip")
        e = np.empty((len(used), WIDTH), held.dtype)
        at = word = 0
        for size, many in zip(*np.unique(sizes, return_counts=True)):
            np.einsum("nsd->nd", held[at : at + size * many].reshape(many, size, WIDTH), out=e[word : word + many])
            at, word = at + size * many, word + many
        e /= roots[:, None]
        n, t = index.shape
        one, both = HIDDEN, 2 * HIDDEN
        forward, backward = e @ self.p["Wf"] + self.p["cf"], e @ self.p["Wb"] + self.p["cb"]
        kind_of = forward.dtype
        for part in (forward, backward):  # what the exponentials below want
            part[:, 2 * one :] *= -2
        x = self.room("x", t, n, 3, 2, one)  # update, reset and candidate, each of both directions
        x[:, :, :, 0] = forward[inverse.T].reshape(t, n, 3, one)
        x[:, :, :, 1] = backward[inverse.T[::-1]].reshape(t, n, 3, one)
        x = x.reshape(t, n, 6 * one)
        m = self.room("m", t, n, 2, one)
        m[:, :, 0], m[:, :, 1] = mask.T[:, :, None], mask.T[::-1, :, None]
        m = m.reshape(t, n, both)
        recur, cand = self._blocks()
        h = np.zeros((n, both), kind_of)
        olds, updates, resets, cands, moved, after = (self.room(k, t, n, both) for k in ("olds", "updates", "resets", "cands", "moved", "after"))
        twice = -2 * cand
        with np.errstate(over="ignore"):  # an exponential without bound is a gate that is shut
            for k in range(t):
                zr = h @ recur
                zr += x[k, :, : 2 * both]
                np.exp(zr, out=zr)
                zr += 1
                np.divide(-1, zr, out=zr)
                zr += 1  # a gate that is shut is 0, not what is too small to multiply fast
                olds[k], updates[k], resets[k] = h, zr[:, :both], zr[:, both:]
                np.multiply(zr[:, both:], h, out=moved[k])
                c = moved[k] @ twice
                c += x[k, :, 2 * both :]
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                np.subtract(c, 1, out=cands[k])
                np.subtract(cands[k], h, out=c)
                c *= zr[:, :both]
                c *= m[k]
                np.add(h, c, out=after[k])
                h = after[k]
        h_all = self.room("h_all", t, n, both)  # by the place of the word
        h_all[:, :, :one], h_all[:, :, one:] = after[:, :, :one], after[::-1, :, one:]
        score = h_all @ self.p["wa"] + (mask.T - 1) * 1e4
        a = np.exp(score - score.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, h_all)
        prob = self._sigmoid(pooled @ self.p["wo"] + self.p["bo"])
        dl = ((prob - y) * weight / n).astype(kind_of)
        g = {"wo": pooled.T @ dl, "bo": np.array([dl.sum()], kind_of)}
        da = dl * (h_all @ self.p["wo"])
        ds = a * (da - (a * da).sum(axis=0))
        g["wa"] = ds.ravel() @ h_all.reshape(-1, both)
        dh_all = np.multiply((a * dl)[:, :, None], self.p["wo"], out=self.room("dh_all", t, n, both))
        dh_all += np.multiply(ds[:, :, None], self.p["wa"], out=self.room("part", t, n, both))
        dh_all[:, :, one:] = dh_all[::-1, :, one:].copy()
        # what does not depend on later steps, for all steps at once
        zm = np.multiply(m, updates, out=self.room("zm", t, n, both))
        to_update = np.subtract(cands, olds, out=self.room("to_update", t, n, both))
        to_update *= zm
        to_update *= np.subtract(1, updates, out=self.room("part", t, n, both))
        to_cand = np.multiply(cands, cands, out=self.room("to_cand", t, n, both))
        np.subtract(1, to_cand, out=to_cand)
        to_cand *= zm
        to_reset = np.multiply(olds, resets, out=self.room("to_reset", t, n, both))
        to_reset *= np.subtract(1, resets, out=self.room("part", t, n, both))
        keep = np.subtract(1, zm, out=zm)
        dx = self.room("dx", t, n, 6 * one)
        dh = np.zeros((n, both), kind_of)
        for k in range(t - 1, -1, -1):
            dh += dh_all[k]
            dz, dr, dc = dx[k, :, :both], dx[k, :, both : 2 * both], dx[k, :, 2 * both :]
            np.multiply(dh, to_update[k], out=dz)
            np.multiply(dh, to_cand[k], out=dc)
            drh = dc @ cand.T
            np.multiply(drh, to_reset[k], out=dr)
            dh *= keep[k]
            drh *= resets[k]
            dh += drh
            dh += dx[k, :, : 2 * both] @ recur.T
        rows = dx.reshape(-1, 6 * one)
        d_recur, d_cand = olds.reshape(-1, both).T @ rows[:, : 2 * both], moved.reshape(-1, both).T @ rows[:, 2 * both :]
        for d, name in enumerate(("Uf", "Ub")):
            own = slice(d * one, (d + 1) * one)
            g[name] = np.concatenate([d_recur[own, own], d_recur[own, both + d * one : both + (d + 1) * one], d_cand[own, own]], axis=1)
        parts = self.room("parts", t, n, 2, 3, one)
        parts[:, :, 0] = dx.reshape(t, n, 3, 2, one)[:, :, :, 0]
        parts[:, :, 1] = dx.reshape(t, n, 3, 2, one)[::-1, :, :, 1]
        parts = _sums(parts.reshape(-1, 6 * one), inverse.T.ravel(), len(used))  # all places of a word together
        dw, dc = e.T @ parts, parts.sum(axis=0)
        for d, (w, c) in enumerate((("Wf", "cf"), ("Wb", "cb"))):
            own = slice(3 * d * one, 3 * (d + 1) * one)
            g[w], g[c] = dw[:, own], dc[own]
        de = parts @ np.concatenate([self.p["Wf"], self.p["Wb"]], axis=1).T / roots[:, None]
        ge = np.empty_like(self.p["E"])
        word_of = np.repeat(np.arange(len(used)), sizes)
        for j, column in enumerate(np.ascontiguousarray(de.T, np.float64)):
            ge[:, j] = np.bincount(flat, weights=column.take(word_of), minlength=BUCKETS)
        g["E"] = ge
        return g


class _Known(dict):
    """Numbers of words, made when first asked for."""

    def __init__(self, make: Callable[[str], int]) -> None:
        self.make = make

    def __missing__(self, w: str) -> int:
        self[w] = at = self.make(w)
        return at


class Data:
    """Windows of documents as indices into a growing list of words."""

    def __init__(self, keep: int = 400_000) -> None:
        self.index: dict[str, int] = {}
        self._bags = Bags()
        self.new: list[str] = []
        self.raw = _Known(self.form)
        self.keep = keep

    def word(self, w: str) -> int:
        return self.raw[w]

    def form(self, w: str) -> int:
        """The number of the form of a word."""
        form = normal(w)
        at = self.index.get(form)
        if at is None:
            at = self.index[form] = len(self.index)
            self.new.append(form)
        return at

    @property
    def bags(self) -> Bags:
        """The slots of all words so far; those of new words are made together."""
        if self.new:
            self._bags.add(self.new)
            self.new = []
        return self._bags

    def cut(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = list(map(self.raw.__getitem__, words(text)))
        starts = windows(len(ids))
        if len(ids) >= WINDOW:
            out = np.array(ids, np.int64)[np.array(starts)[:, None] + _STEPS]
            return out, np.ones(out.shape, np.float32)
        out = np.zeros((len(starts), WINDOW), np.int64)
        mask = np.zeros((len(starts), WINDOW), np.float32)
        out[:, : len(ids)], mask[:, : len(ids)] = ids, 1
        return out, mask


def verdicts(labels: pd.DataFrame) -> dict[int, float]:
    """Probability that a document is abusive, from reviewers of estimated reliability (expectation-maximisation)."""
    l = labels.dropna(subset=["doc_id", "verdict"]).drop_duplicates(["doc_id", "reviewer", "verdict"])
    if not len(l):
        return {}
    truth = l.groupby("doc_id")["verdict"].mean()
    for _ in range(10):
        y = l["doc_id"].map(truth)
        v = l["verdict"]
        stat = pd.DataFrame({"r": l["reviewer"].fillna(""), "tp": y * v, "p": y, "fp": (1 - y) * v, "n": 1 - y}).groupby("r").sum()
        sens = ((stat["tp"] + 8) / (stat["p"] + 10)).clip(0.55, 0.99)
        fall = ((stat["fp"] + 0.6) / (stat["n"] + 10)).clip(0.01, 0.45)
        prior = float(np.clip(truth.mean(), 0.01, 0.6))
        s, f = l["reviewer"].fillna("").map(sens), l["reviewer"].fillna("").map(fall)
        odds = np.where(v == 1, np.log(s / f), np.log((1 - s) / (1 - f)))
        total = pd.Series(odds, index=l["doc_id"].to_numpy()).groupby(level=0).sum() + np.log(prior / (1 - prior))
        truth = 1 / (1 + np.exp(-total))
    return truth.to_dict()


def train(texts: list[str], y: np.ndarray, seed: int = 7, rounds: int = 3, epochs: int = 6, batch: int = 128, speed: float = 0.006) -> tuple[Network, float]:
    """Network and threshold fitted to documents with probabilities ``y`` of being abusive.

    In the first round the windows of a positive document are told from the others by words that positive documents
    have and negative ones have not; in later rounds by the network itself. Labels that the rest contradicts are dropped.
    """
    rng = np.random.default_rng(seed)
    data = Data()
    cuts = [data.cut(t) for t in texts]
    index = np.concatenate([c[0] for c in cuts]) if cuts else np.zeros((0, WINDOW), np.int64)
    mask = np.concatenate([c[1] for c in cuts]) if cuts else np.zeros((0, WINDOW), np.float32)
    doc = np.repeat(np.arange(len(cuts)), [len(c[0]) for c in cuts])
    y = np.asarray(y, dtype=float)
    net = Network(seed)
    if not len(index) or (y > 0.5).sum() == 0 or (y < 0.5).sum() == 0:
        net.p["bo"][:] = -9
        return net, 0.5
    in_pos, in_neg = np.full(len(data.bags), 0.0), np.full(len(data.bags), 0.0)
    for i, c in enumerate(cuts):
        own = np.unique(c[0][c[1] > 0])
        in_pos[own] += y[i]
        in_neg[own] += 1 - y[i]
    rate = np.log((in_pos + 0.1) / (y.sum() + 1)) - np.log((in_neg + 0.1) / ((1 - y).sum() + 1))
    rate = np.where(in_pos + in_neg >= 2, rate, 0.0)
    value = np.where(mask > 0, rate[index], -9)
    belief = np.sort(value, axis=1)[:, -5:].clip(-1, 4).mean(axis=1)
    positive = y[doc] > 0.5
    blank = data.word("#")
    bags = data.bags
    for turn in range(rounds):
        top = pd.Series(belief).groupby(doc).transform("max").to_numpy()
        if turn == 0:
            chosen = positive & (belief >= np.maximum(0.75 * top, 1.0))
            loose = positive & ~chosen & (belief > 0.3)
        else:
            chosen = positive & ((belief > 0.5) | (belief >= 0.9 * top) & (top > 0.2))
            loose = positive & ~chosen & (belief > 0.15)
            loose |= ~positive & (belief > 0.93)  # a review that the rest contradicts
        target = chosen.astype(np.float32)
        pos, neg = np.flatnonzero(chosen), np.flatnonzero(~chosen & ~loose)
        net = Network(seed)
        m = {k: np.zeros_like(v) for k, v in net.p.items()}
        s = {k: np.zeros_like(v) for k, v in net.p.items()}
        room = {k: np.zeros_like(v) for k, v in net.p.items()}
        blocks = [(k, i) for k, v in net.p.items() for i in range(0, len(v), BLOCK)]
        step = 0
        for epoch in range(epochs):
            quota = min(len(neg), MOST_WINDOWS // 2, max(3000, 6 * len(pos)))
            if turn and epoch:  # windows that are hard to tell apart come in each epoch
                hard = neg[np.argsort(-belief[neg], kind="stable")[: quota // 3]]
                easy = rng.choice(neg, quota - len(hard), replace=False)
                negs = np.concatenate([hard, easy])
            else:
                negs = rng.choice(neg, quota, replace=False)
            some = pos if len(pos) <= MOST_WINDOWS // 2 else rng.choice(pos, MOST_WINDOWS // 2, replace=False)
            times = max(1, int(round(len(negs) / max(len(some), 1) / 4)))
            order = rng.permutation(np.concatenate([*[some] * times, negs]))
            for at in range(0, len(order), batch):
                b = order[at : at + batch]
                idx = index[b].copy()
                drop = (rng.random(idx.shape) < 0.08) & (mask[b] > 0)
                idx[drop] = blank
                g = net.gradients(idx, mask[b], target[b] * 0.98 + 0.01, np.ones(len(b), np.float32), bags)
                step += 1
                rate_now = speed * min(1, step / 50) * (1 - 0.8 * epoch / epochs)
                for k, i in blocks:
                    v, mean, square, part, own = g[k][i : i + BLOCK], m[k][i : i + BLOCK], s[k][i : i + BLOCK], room[k][i : i + BLOCK], net.p[k][i : i + BLOCK]
                    np.subtract(v, mean, out=part)
                    part *= 0.1
                    mean += part
                    np.multiply(v, v, out=part)
                    part -= square
                    part *= 0.01
                    square += part
                    np.multiply(square, 1 / (1 - 0.99**step), out=part)
                    np.sqrt(part, out=part)
                    part += 1e-7
                    np.divide(mean, part, out=part)
                    part *= rate_now / (1 - 0.9**step)
                    own *= 1 - rate_now * 1e-4
                    own -= part
        belief = probabilities(net, data, index, mask)
    # the threshold that agrees best with the reviews
    best = pd.Series(belief).groupby(doc).max().reindex(range(len(cuts)), fill_value=0.0).to_numpy()
    marks = np.linspace(0.2, 0.95, 16)
    gain = [2 * (y * (best >= t)).sum() / ((best >= t).sum() + y.sum() + 1e-9) - 1e-3 * abs(t - 0.6) for t in marks]
    return net, float(marks[int(np.argmax(gain))])


def probabilities(net: Network, data: Data, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    forward, backward = net.halves(net.project(data.bags))
    return _read_all(net, forward, backward, index, mask)


def _read_all(net: Network, forward: np.ndarray, backward: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Probabilities of all windows; those shorter than a window are read last, so that the others need no mask."""
    out = np.zeros(len(index), np.float32)
    order = np.argsort(mask[:, -1] == 0, kind="stable")
    for at in range(0, len(index), BATCH):
        b = order[at : at + BATCH]
        out[b] = net.read(forward, backward, index[b], mask[b])
    return out


def fit(documents: DataFrame, labels: DataFrame) -> tuple[Network, float]:
    """Network and threshold from reviewed documents, at most ``MOST_DOCUMENTS`` of them, picked by a hash of their id."""
    known = labels.select("doc_id", "reviewer", "verdict").where("doc_id is not null and verdict is not null").distinct()
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_DOCUMENTS)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    truth = verdicts(known.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "reviewer", "verdict").toPandas())
    return train(rows["text"].tolist(), np.array([truth[i] for i in rows["doc_id"]], dtype=float))


def scores(documents: DataFrame, net: Network, carry: list[str] = ()) -> DataFrame:
    """doc_id, score, and the columns to carry: the highest probability of any window; 0 for null or empty texts."""
    kept = list(carry)
    p = {k: v for k, v in net.p.items()}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Network()
        own.p = p
        data = Data()
        forward = backward = np.zeros((3, 0, HIDDEN), np.float32)
        for pdf in batches:
            if len(data.raw) > data.keep:
                data = Data()
                forward = backward = np.zeros((3, 0, HIDDEN), np.float32)
            cuts = [data.cut(t) if t else (np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.float32)) for t in pdf["text"]]
            if len(data.bags) > forward.shape[1]:
                ahead, behind = own.halves(own.project(data.bags, forward.shape[1]))
                forward, backward = np.concatenate([forward, ahead], axis=1), np.concatenate([backward, behind], axis=1)
            out = np.zeros(len(pdf))
            index = np.concatenate([c[0] for c in cuts])
            mask = np.concatenate([c[1] for c in cuts])
            doc = np.repeat(np.arange(len(cuts)), [len(c[0]) for c in cuts])
            np.maximum.at(out, doc, _read_all(own, forward, backward, index, mask))
            yield pdf[["doc_id", *kept]].assign(score=out)

    rows = documents.select("doc_id", *kept, "text")
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(score, ", ".join(f"{c} {kinds[c]}" for c in ["doc_id", *kept]) + ", score double")
