"""Languages of sentences, segments and documents by a mixture over n-gram likelihoods.

Character trigram models of the languages are learnt from the corpus itself: sentences that hold unmistakable function
words or a script of one language start them, and expectation-maximisation over all sentences refines them. Then, for
each document, expectation-maximisation estimates the proportions of the languages, and a penalised likelihood decides
which languages it holds at all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.lookalikes import TO_LATIN, fold
from lexloom.llm.sentences import split
from lexloom.session import cut

#: Components of the mixture; bn_latn is Bengali in Latin letters and counts as bn, hi_latn as hi.
COMPONENTS = ("en", "bn", "bn_latn", "hi", "fr", "zh")
LANGUAGE = {"en": "en", "bn": "bn", "bn_latn": "bn", "hi": "hi", "fr": "fr", "zh": "zh"}
BUCKETS = 1 << 16
#: Words whose scores a task keeps at once.
MOST_WORDS = 200_000
# Function words that start the models.
SEEDS = {
    "en": frozenset("the of and to in is are was were for by on with shall may any which that be been this not has have an at or from".split()),
    "fr": frozenset("le la les des du de et un une est sont dans pour par sur avec qui que au aux ne pas ce cette ont été peut sous".split()),
    "bn_latn": frozenset("er ke kache jonno hobe hoben korte koren ei kono theke ebong moddhe diben dibe onujayi odhine babod parben chara take jodi tobe hishab tika songkranto".split()),
}
# Names and codes of languages as labels spell them.
LABELS = {
    "en": "en eng english en-gb en-us en_us en_gb anglais",
    "bn": "bn ben bengali bangla bn-bd bn-in bn_bd bn-latn বাংলা",
    "hi": "hi hin hindi hi-in हिन्दी हिंदी",
    "fr": "fr fra fre french fr-fr français francais",
    "zh": "zh zho chi chinese zh-cn zh-tw zh-hans zh-hant cmn mandarin 中文 汉语",
    "mixed": "mixed mul multi multiple mix bilingual",
}
_NAMED = {name: lang for lang, names in LABELS.items() for name in names.split()}
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-෿]+[^\W\d_]*)*")
# no component is written in Greek or Cyrillic, so a letter of theirs stands for the Latin one it is drawn like
_DRAWN = str.maketrans(TO_LATIN)
_HAN = re.compile("[㐀-鿿]")
_SCRIPTS = (("bn", re.compile("[ঀ-৿]")), ("hi", re.compile("[ऀ-ॣ०-ॿ]")), ("zh", re.compile("[㐀-鿿]")))


def label_of(value: str | None) -> str:
    """The language a label names, or an empty string for a missing or unknown one."""
    return _NAMED.get((value or "").strip().lower(), "")


def words(sentence: str) -> list[str]:
    """Words in small letters, each Han letter by itself."""
    return _HAN.sub(r" \g<0> ", " ".join(w.lower() for w in _WORD.findall(fold(sentence).translate(_DRAWN)))).split()


def _slots(word: str) -> list[int]:
    w = f" {word} "
    return [zlib.crc32(w[i : i + 3].encode()) % BUCKETS for i in range(len(w) - 2)]


class Words(dict):
    """Numbers of words as they come, with what is known of each: script, seeds and trigrams."""

    def __init__(self) -> None:
        self.facts: list[tuple[float, ...]] = []
        self.slots: list[list[int]] = []

    def __missing__(self, w: str) -> int:
        at = self[w] = len(self.facts)
        kind = next((lang for lang, p in _SCRIPTS if p.match(w)), "")
        self.facts.append((*(float(kind == lang) * len(w) for lang, _ in _SCRIPTS), len(w), *(float(w in seeds) for seeds in SEEDS.values())))
        self.slots.append(_slots(w))
        return at

    def read(self, batch: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all words, ends of all sentences among them, ends of all records among the sentences."""
        parts = [s.split() for r in batch for s in r]
        flat = np.fromiter((self[w] for p in parts for w in p), np.int64)
        return flat, np.cumsum([0, *map(len, parts)]), np.cumsum([0, *map(len, batch)])

    def learnable(self) -> np.ndarray:
        """Words by components: a component learns from the script it is written in only."""
        own = np.array([x[: len(_SCRIPTS)] for x in self.facts]).reshape(-1, len(_SCRIPTS)) > 0
        latin = ~own.any(axis=1)
        names = [lang for lang, _ in _SCRIPTS]
        return np.stack([own[:, names.index(c)] if c in names else latin for c in COMPONENTS], axis=1)


def _sums(values: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values[flat], axis=0)])
    return total[ends[1:]] - total[ends[:-1]]


class Scorer:
    """Log likelihoods of words under every component; a word is scored once."""

    def __init__(self, logp: np.ndarray) -> None:
        self.logp, self.words, self.values = logp, Words(), np.zeros((0, len(COMPONENTS)))

    def read(self, batch: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the sentences of a batch, beside what ``Words.read`` gives."""
        if len(self.words) > MOST_WORDS:
            self.__init__(self.logp)
        flat, ends, records = self.words.read(batch)
        new = self.words.slots[len(self.values) :]
        if new:
            sizes = np.fromiter(map(len, new), np.int64)
            picked = self.logp[:, np.concatenate(new)]
            # every letter stands in three trigrams
            self.values = np.concatenate([self.values, np.add.reduceat(picked, np.cumsum(sizes) - sizes, axis=1).T / 3])
        return _sums(self.values, flat, ends), flat, ends, records


def seeds_of(facts: np.ndarray) -> np.ndarray:
    """Component of every unmistakable sentence, else -1, by the sums of its words' facts."""
    k = len(_SCRIPTS)
    letters, hits = facts[:, k], facts[:, k + 1 :]
    out = np.full(len(facts), -1)
    names, best = list(SEEDS), hits.argmax(axis=1)
    top = hits.max(axis=1)
    out = np.where((top >= 3) & (top >= 4 * (hits.sum(axis=1) - top)), np.array([COMPONENTS.index(x) for x in names])[best], out)
    for i, (lang, _) in enumerate(_SCRIPTS):
        out = np.where((facts[:, i] > 0) & (facts[:, i] >= 0.6 * letters), COMPONENTS.index(lang), out)
    return out


def infer(scores: np.ndarray, evidence: float = 1.0, penalty: float = 4.0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Component of every sentence and its posterior, by a mixture fitted to one document.

    ``scores`` are log likelihoods, sentences by components; ``evidence`` is the number of words. Starting from the
    languages that are best for some sentence, the language whose removal costs the likelihood less than ``penalty`` and
    half the logarithm of the evidence (the Bayesian information criterion for its proportion) is dropped, the cheapest
    first, until none is.
    """
    n, k = scores.shape
    least = penalty + 0.5 * math.log(max(evidence, 1.0))

    def fit(some: list[int]) -> tuple[float, np.ndarray]:
        x = scores[:, some]
        top = x.max(axis=1, keepdims=True)
        e = np.exp(x - top)
        pi = np.full(len(some), 1 / len(some))
        for _ in range(rounds):
            r = e * pi
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            pi = (r.sum(axis=0) + 0.05) / (n + 0.05 * len(some))
        return float((np.log(np.maximum((e * pi).sum(axis=1), 1e-300)) + top[:, 0]).sum()), e * pi

    alive = sorted(set(scores.argmax(axis=1).tolist()))
    if len(alive) == 1:
        return np.full(n, alive[0]), np.ones(n)
    like, parts = fit(alive)
    while len(alive) > 1:
        tries = [(*fit([a for a in alive if a != x]), x) for x in alive]
        new, new_parts, x = max(tries, key=lambda t: t[0])
        if new < like - least:
            break
        alive, like, parts = [a for a in alive if a != x], new, new_parts
    post = parts / np.maximum(parts.sum(axis=1, keepdims=True), 1e-300)
    return np.array(alive)[post.argmax(axis=1)], post.max(axis=1)


def _infer_batch(x: np.ndarray, ends: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``infer`` for every record of a batch."""
    best, sure = x.argmax(axis=1) if len(x) else np.zeros(0, np.int64), np.ones(len(x))
    for a, b in zip(records[:-1], records[1:]):
        if b > a + 1 and (best[a:b] != best[a]).any():
            best[a:b], sure[a:b] = infer(x[a:b], float(ends[b] - ends[a]))
    return best, sure


def sentence_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """record_key and the words of its sentences, one string each; written once, as every round reads it.

    Null and blank texts have no sentence and are left out, repeated rows count once.
    """

    def cut_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [[" ".join(words(t[b:e])) for b, e in split(t)] for t in pdf["unit"]]
            yield pd.DataFrame({"record_key": pdf["record_key"], "sentences": out})

    rows = df.select(F.col(key).cast("string").alias("record_key"), F.col(text).alias("unit")).where(F.length("unit") > 0).distinct()
    return cut(rows.mapInPandas(cut_words, "record_key string, sentences array<string>").where(F.size("sentences") > 0))


def learn_models(rows: DataFrame, rounds: int = 2, floor: float = 0.02) -> np.ndarray:
    """Log probabilities of hashed trigrams per component, learnt from all sentences of ``sentence_words``.

    Every component is mixed with the corpus at large by the same share ``floor``, so that a trigram a component has
    never met speaks neither for it nor against the others that have not met it. What reaches the driver is one number
    per component and bucket, whatever the size of the table.
    """
    logp: np.ndarray | None = None
    k = len(COMPONENTS)
    for _ in range(rounds):
        model = logp

        def count(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, BUCKETS))
            scorer = Scorer(model if model is not None else np.zeros((k, BUCKETS), np.float32))

            def add(seen: np.ndarray, own: Words) -> None:
                part = seen.reshape(-1, k) * own.learnable()[: len(seen) // k]
                for slots, ns in zip(own.slots, part):
                    for s in slots:
                        total[:, s] += ns

            seen = np.zeros(0)
            for pdf in batches:
                before = scorer.words
                x, flat, ends, records = scorer.read(pdf["sentences"])
                own = scorer.words
                if own is not before:
                    add(seen, before)
                    seen = np.zeros(0)
                if model is None:
                    picks = seeds_of(_sums(np.array(own.facts).reshape(len(own), -1), flat, ends)) if len(own) else np.zeros(0, np.int64)
                    weight = (picks >= 0).astype(float)
                else:
                    picks, weight = _infer_batch(x, ends, records)
                sizes = np.diff(ends)
                place = flat * k + np.repeat(np.maximum(picks, 0), sizes)
                got = np.bincount(place, weights=np.repeat(weight, sizes), minlength=len(own) * k)
                got[: len(seen)] += seen
                seen = got
            add(seen, scorer.words)
            c, s = np.nonzero(total)
            yield pd.DataFrame({"c": c.astype("int32"), "s": s.astype("int32"), "n": total[c, s]})

        got = rows.select("sentences").mapInPandas(count, "c int, s int, n double").groupBy("c", "s").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((k, BUCKETS))
        counts[got["c"], got["s"]] = got["n"]
        share = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
        own = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
        logp = np.log((1 - floor) * own + floor * share).astype(np.float32)
    return logp


def fit_models(df: DataFrame, key: str, text: str, rounds: int = 2) -> np.ndarray:
    """``learn_models`` for the sentences of a table's texts."""
    return learn_models(sentence_words(df, key, text), rounds)


def tagged_sentences(rows: DataFrame, logp: np.ndarray) -> DataFrame:
    """record_key, sentence_no, lang and confidence of every sentence of ``sentence_words``."""
    names = np.array([LANGUAGE[c] for c in COMPONENTS], dtype=object)

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(logp)
        for pdf in batches:
            x, _, ends, records = scorer.read(pdf["sentences"])
            found, sure = _infer_batch(x, ends, records)
            sizes = np.diff(records)
            nos = np.arange(1, len(found) + 1) - np.repeat(records[:-1], sizes)
            yield pd.DataFrame({"record_key": np.repeat(pdf["record_key"].to_numpy(), sizes), "sentence_no": nos.astype("int32"), "lang": names[found], "confidence": sure})

    return rows.mapInPandas(tag, "record_key string, sentence_no int, lang string, confidence double")


def sentence_languages(df: DataFrame, key: str, text: str, logp: np.ndarray) -> DataFrame:
    """record_key, sentence_no, lang and confidence of every sentence of every text. Blank and null texts have none."""
    return tagged_sentences(sentence_words(df, key, text), logp)


def segments(tagged: DataFrame) -> DataFrame:
    """Maximal runs of sentences in one language, of texts that hold more than one: segment_no, lang, confidence."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, rows in zip(pdf["record_key"], pdf["rows"]):
                at, no, total = None, 0, []
                for x in sorted(rows, key=lambda r: r["sentence_no"]):
                    if x["lang"] != at:
                        at, no = x["lang"], no + 1
                        total.append([k, no, at, 0.0, 0])
                    total[-1][3] += x["confidence"]
                    total[-1][4] += 1
                if no > 1:
                    out += [(k, no, lang, p / n) for k, no, lang, p, n in total]
            yield pd.DataFrame(out, columns=["record_key", "segment_no", "lang", "confidence"])

    whole = tagged.groupBy("record_key").agg(F.collect_list(F.struct("sentence_no", "lang", "confidence")).alias("rows"), F.min("lang").alias("a"), F.max("lang").alias("b"))
    return whole.where("a <> b").select("record_key", "rows").mapInPandas(runs, "record_key string, segment_no int, lang string, confidence double")


def document_languages(tagged: DataFrame, owner: DataFrame, share: float = 0.2) -> DataFrame:
    """owner_key, lang, confidence: the language of most sentences, or mixed if the second has at least ``share``.

    ``owner`` maps record_key to owner_key. Ties go to the language first in the alphabet.
    """
    counts = tagged.join(owner, "record_key").groupBy("owner_key", "lang").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("owner_key").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "lang"))).alias("top"))
    second = F.coalesce(-F.try_element_at("top", F.lit(2))["minus"], F.lit(0))
    first = F.col("top")[0]
    return ranked.select(
        "owner_key",
        F.when(second >= share * F.col("total"), "mixed").otherwise(first["lang"]).alias("lang"),
        (-first["minus"] / F.col("total")).alias("confidence"),
    )
