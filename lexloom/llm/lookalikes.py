"""One form for text that looks the same but differs in its characters.

Folding brings every text to composed letters, ordinary widths and plain blanks, drops what cannot be seen, and writes
vowels that print as one letter as that letter. What is left are letters of one script drawn like those of another.
They are repaired token by token and script-aware: the dominant script of a token is found, letters of other scripts
are replaced by the look-alike of the dominant one, and the result is taken only if it stands in the corpus vocabulary.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

# Letters drawn like a Latin letter, by script.
LATIN_OF_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЗҮԌԚԜѴаеѕіјорсухѵԁһԛԝӏԍ", "ABESIJKMHOPCTYX3YGQWVaesijopcyxvdhqwlg"))
LATIN_OF_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικαρυχϲϳ", "ABEZHIKMNOPTYXovikapuxcj"))
LATIN_OF_ARMENIAN = dict(zip("օսցհոՕՍ", "ougհnOU")) | {"հ": "h"}
LATIN_OF_CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))
LATIN_OF_LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
LATIN_OF_OTHERS = dict(zip("ℓıɑɡᴏᴄᴠᴢ", "liagocvz"))
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# A letter and a sign that print as one letter, which normalisation leaves apart, with that letter.
ONE_LETTER = dict(
    x.split("=")
    for x in """
    অা=আ ঋৃ=ৠ ঌৢ=ৡ
    अा=आ अॅ=ॲ अॉ=ऑ अो=ओ अौ=औ अॊ=ऒ अॆ=ऄ आॅ=ऑ आॆ=ऒ आे=ओ आै=औ एॅ=ऍ एॆ=ऎ एे=ऐ उु=ऊ
    ਅਾ=ਆ ਅੈ=ਐ ਅੌ=ਔ ੲਿ=ਇ ੲੀ=ਈ ੲੇ=ਏ ੳੁ=ਉ ੳੂ=ਊ ੳੋ=ਓ
    અા=આ અૅ=ઍ અે=એ અૈ=ઐ અૉ=ઑ અો=ઓ અૌ=ઔ
    ଅା=ଆ ଏୗ=ଐ ଓୗ=ଔ
    அூ=ஆ
    ఒౕ=ఓ ఒౌ=ఔ
    ಉಾ=ಊ ಒೌ=ಔ
    ഇൗ=ഈ ഉൗ=ഊ എെ=ഐ ഒാ=ഓ ഒൗ=ഔ
    අා=ආ අැ=ඇ අෑ=ඈ උෟ=ඌ ඍෘ=ඎ ඏෟ=ඐ එ්=ඒ එෙ=ඓ ඔෟ=ඖ
    """.split()
)
_ONE_LETTER = regex.compile("|".join(ONE_LETTER))

_TABLES = {"CYRILLIC": LATIN_OF_CYRILLIC, "GREEK": LATIN_OF_GREEK, "ARMENIAN": LATIN_OF_ARMENIAN, "CHEROKEE": LATIN_OF_CHEROKEE, "LISU": LATIN_OF_LISU}
TO_LATIN = {k: v for t in (*_TABLES.values(), LATIN_OF_OTHERS) for k, v in t.items() if v.isalpha()}
_FROM_LATIN = {name: {v: k for k, v in t.items() if v.isalpha()} for name, t in _TABLES.items()}

_BLANKS = dict.fromkeys([9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], " ")
_HIDDEN = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xFFF9, 0xFFFC), *range(0xE0100, 0xE01F0)])
_WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOLD = _BLANKS | _HIDDEN | _WIDE | {ord(k): v for k, v in LIGATURES.items()} | {0x212A: "K", 0x212B: "Å"}
_HALF = regex.compile("[｡-ￜ]+")
# letters of mathematics and of the letterlike block stand for the letters they are drawn like
_DRAWN = regex.compile("[ℂℊℋℌℍℎℐℑℒℕℙℚℛℜℝℤℨℬℭℯℰℱℳℴ\U0001d400-\U0001d7cb]+")
_SUSPECT = "[" + "".join(TO_LATIN) + "]"
_LETTERS = regex.compile(_SUSPECT)
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Lisu}" + "".join(LATIN_OF_OTHERS) + "]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")


def fold(text: str | None) -> str | None:
    """Composed letters, ordinary widths, plain blanks, nothing invisible; case, accents and raised digits stay."""
    if text is None or text.isascii() and not any(c in text for c in "\t\n\r\v\f\x1c\x1d\x1e\x1f"):
        return text
    return composed(text.translate(_FOLD))


def composed(text: str) -> str:
    """Letters and signs that print as one letter, written as one."""
    for pattern in (_HALF, _DRAWN):
        text = pattern.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    out = unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", _ONE_LETTER.sub(lambda m: ONE_LETTER[m.group()], out)) if _ONE_LETTER.search(out) else out


def script(c: str) -> str:
    """First word of a letter's Unicode name, which names its script; empty for what is no letter."""
    return unicodedata.name(c, "").split(" ")[0].split("-")[0] if c.isalpha() else ""


def proposals(token: str) -> list[str]:
    """Composed forms a token may have meant, best first: its dominant script, the other scripts it holds, Latin."""
    letters = unicodedata.normalize("NFD", token)  # an accent stays what it is, whatever script its letter is of
    counts = Counter(s for s in map(script, letters) if s)
    order = [s for s, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0] != "LATIN", x[0]))]
    out: list[str] = []
    for target in dict.fromkeys([*order, "LATIN"]):
        if target == "LATIN":
            made = "".join(TO_LATIN.get(c, c) for c in letters)
        elif target in _FROM_LATIN:
            back = _FROM_LATIN[target]
            made = "".join(c if script(c) == target else back.get(TO_LATIN.get(c, c), c) for c in letters)
        else:
            continue
        made = composed(made)
        if made != token and made not in out and len({s for s in map(script, made) if s}) == 1:
            out.append(made)
    return out


def odd_tokens(text: str) -> list[str]:
    """Different tokens of a folded text that may hold letters of another script than the one meant.

    Tokens of several scripts, and tokens wholly of look-alikes. The latter stay out where the text has a word of their
    script with a letter that no other script draws: the text is in this script then.
    """
    if not _FOREIGN.search(text):
        return []
    out, whole, home = [], [], set()
    for token in dict.fromkeys(_WORD.findall(text)):
        if not _FOREIGN.search(token):
            continue
        scripts = {s for s in map(script, token) if s}
        if len(scripts) > 1:
            out.append(token)
        elif all(c in TO_LATIN for c in unicodedata.normalize("NFD", token) if c.isalpha()):
            whole.append((token, scripts))
        else:
            home |= scripts
    return out + [t for t, scripts in whole if not scripts & home]


def canonical(df: DataFrame) -> DataFrame:
    """field_name, row_key, own (digest of the value) and ``canon``, the one form that all values of one look share.

    Rows (field_name, row_key, value) repeat once. Null values are left out, an empty value stays empty. A token is
    changed only when the repaired form is known: it stands in the vocabulary of all values, or two different spellings
    come to it. Texts are folded once, into a checkpoint; tokens are repaired once each, whatever the number of texts.
    """
    rows = df.select("field_name", "row_key", "value").where(F.col("value").isNotNull()).distinct()

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            plain = pdf["value"].map(fold)
            own = [hashlib.sha1(v.encode("utf-8", "surrogatepass")).hexdigest() for v in pdf["value"]]
            yield pd.DataFrame({"field_name": pdf["field_name"], "row_key": pdf["row_key"], "own": own, "plain": plain, "odd": plain.map(odd_tokens)})

    base = cut(rows.mapInPandas(prepare, "field_name string, row_key string, own string, plain string, odd array<string>"))
    held = base.where(F.size("odd") > 0)

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(t, made, rank) for t in pdf["token"] for rank, made in enumerate(proposals(t))]
            yield pd.DataFrame(out, columns=["token", "made", "rank"])

    tokens = held.select(F.explode("odd").alias("token")).distinct()
    wanted = cut(tokens.mapInPandas(propose, "token string, made string, rank int"))
    # the vocabulary: words that hold no look-alike, or a letter of their script that no other script draws
    of_one = reduce(lambda a, b: a | b, [F.col("made").rlike(rf"^[\p{{Is{n}}}\p{{M}}]+$") & F.regexp_replace("made", _SUSPECT, "").rlike(r"\p{L}") for n in ("Cyrillic", "Greek", "Armenian")])
    words = base.select(F.explode(F.split("plain", r"[^\p{L}\p{M}\p{N}_]+")).alias("made")).where(F.length("made") > 0)
    sure = words.where(~F.col("made").rlike(_SUSPECT) | of_one).distinct()
    known = wanted.select("made").distinct().join(sure, "made", "left_semi").select("made", F.lit(0).alias("weak"))
    twice = wanted.groupBy("made").agg(F.count_distinct("token").alias("n")).where("n > 1").select("made", F.lit(1).alias("weak"))
    least = known.unionByName(twice).groupBy("made").agg(F.min("weak").alias("weak"))
    taken = wanted.join(least, "made").groupBy("token").agg(F.min_by("made", F.struct("weak", "rank", "made")).alias("made"))
    key = ["field_name", "row_key", "own"]
    repairs = held.select(*key, F.explode("odd").alias("token")).join(taken, "token").groupBy(*key).agg(F.collect_list(F.struct("token", "made")).alias("repairs"))

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, todo in zip(pdf["plain"], pdf["repairs"]):
                made = {x["token"]: x["made"] for x in todo} if todo is not None else {}
                out.append(_WORD.sub(lambda m: made.get(m.group(), m.group()), text) if made else text)  # noqa: B023
            yield pdf[key].assign(canon=out)

    mended = held.select(*key, "plain").join(repairs, key, "left").mapInPandas(repair, "field_name string, row_key string, own string, canon string")
    return base.where(F.size("odd") == 0).select(*key, F.col("plain").alias("canon")).unionByName(mended)


def _forms(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with the identity of their look, and the columns that name it."""
    forms = canonical(df).select("field_name", "row_key", "own", F.xxhash64("canon").alias("h1"), F.hash("canon").alias("h2")).distinct()
    return forms, ["field_name", "h1", "h2"]


def look_alike_classes(df: DataFrame) -> DataFrame:
    """field_name, row_key, class_id, links: the class of rows of one look, and how many of them differ in code points.

    One row per different value of a key, however large a class is; nothing is paired. Empty values are a class, too.
    """
    forms, look = _forms(df)
    sizes = forms.groupBy(*look, "own").agg(F.count("*").alias("n"))
    whole = sizes.groupBy(*look).agg(F.sum("n").alias("all"))
    links = sizes.join(whole, look).select(*look, "own", (F.col("all") - F.col("n")).alias("links"))
    return forms.join(links, [*look, "own"]).select("field_name", "row_key", F.concat(F.hex("h1"), F.hex("h2")).alias("class_id"), "links").distinct()


def look_alike_pairs(df: DataFrame, most: int = 2_000) -> DataFrame:
    """Pairs of different rows (field_name, row_key, value) of the same look whose values differ in code points.

    Keys that read as numbers are ordered as numbers, others as text. Ties and repeated rows count once. A class of more
    than ``most`` rows is dealt over several tasks: each takes a part of its rows against all of them.
    """
    forms, look = _forms(df)
    forms = cut(forms)
    several = forms.groupBy(*look).agg(F.min("own").alias("a"), F.max("own").alias("b"), F.count("*").alias("n")).where("a <> b")
    some = forms.join(several.select(*look, F.ceil(F.col("n") / most).cast("int").alias("parts")), look)
    a = some.withColumn("part", F.pmod(F.hash("row_key", "own"), F.col("parts"))).alias("a")
    b = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    smaller = F.when(number("a.row_key").isNotNull() & number("b.row_key").isNotNull(), number("a.row_key") < number("b.row_key")).otherwise(F.col("a.row_key") < F.col("b.row_key"))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*look, "part")])
    pairs = a.join(b, same & (F.col("a.own") != F.col("b.own")) & smaller)
    return pairs.select(F.col("a.field_name").alias("field_name"), F.col("a.row_key").alias("key_lo"), F.col("b.row_key").alias("key_hi")).distinct()


def values(df: DataFrame, field: str, key: str, value: str) -> DataFrame:
    """Rows (field_name, row_key, value) of one field."""
    return df.select(F.lit(field).alias("field_name"), F.col(key).cast("string").alias("row_key"), F.col(value).cast("string").alias("value"))
