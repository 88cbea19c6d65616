"""Column functions on bilingual text: character classes, normal forms, lines, digits, token estimates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
BLOCK = r"\x{0980}-\x{09FF}"
VOWEL_SIGNS = r"\x{09BE}-\x{09C4}\x{09C7}\x{09C8}\x{09CB}\x{09CC}"
COPYRIGHT_PHRASES = ("Copyright", "Legislative and Parliamentary Affairs Division", "Ministry of Law, Justice and Parliamentary Affairs")
FOOTER_DOMAINS = (r"bdlaws\.minlaw\.gov\.bd",)
CLAUSE_SPECIALS = ("xial", "xiaa", "bis", "ter")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Blanks of any kind off both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def count_of(c: Column | str, character_class: str) -> Column:
    """Number of characters of a class."""
    return F.length(F.regexp_replace(_col(c), f"[^{character_class}]", ""))


def bangla_count(c: Column | str) -> Column:
    return count_of(c, BLOCK)


def letter_count(c: Column | str) -> Column:
    return count_of(c, r"\p{L}")


def bangla_ratio(c: Column | str) -> Column:
    """Characters of the Bengali block per letter; null without letters. Signs and digits count above, not below."""
    n = letter_count(c)
    return F.when(n > 0, bangla_count(c) / n)


def is_mostly_bangla(c: Column | str, threshold: float = 0.3) -> Column:
    return F.coalesce(bangla_ratio(c) > threshold, F.lit(False))


def document_language(c: Column | str) -> Column:
    """bn above 0.8, mixed above 0.15, else en."""
    return F.when(is_mostly_bangla(c, 0.8), "bn").when(is_mostly_bangla(c, 0.15), "mixed").otherwise("en")


def query_language(c: Column | str) -> Column:
    return F.when(is_mostly_bangla(c, 0.3), "bn").otherwise("en")


def _nfc(c: Column) -> Column:
    @F.pandas_udf("string")  # made on use: a worker that imports this module has no session to make it in
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return run(c)


def normalize_unicode(c: Column | str) -> Column:
    """Composed form without zero-width characters. Text of plain ASCII skips the Python step's work by being equal."""
    return F.regexp_replace(_nfc(_col(c)), r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", "")


def bengali_to_int(c: Column | str) -> Column:
    return F.coalesce(F.translate(_col(c), BENGALI_DIGITS, "0123456789").try_cast("int"), F.lit(0))


def int_to_bengali(c: Column | str) -> Column:
    return F.translate(_col(c).cast("string"), "0123456789", BENGALI_DIGITS)


def is_noise_line(c: Column | str) -> Column:
    """A short line that is mostly dependent vowel signs."""
    solid = F.regexp_replace(_col(c), r"(?U)\s", "")
    n, signs = F.length(solid), count_of(solid, VOWEL_SIGNS)
    others = F.length(F.regexp_replace(F.regexp_replace(solid, f"[{BLOCK}]", ""), r"\P{L}", ""))
    short = (n <= 4) & (signs >= n * 0.5)
    sparse = (n <= 6) & (bangla_count(solid) > 0) & (others == 0) & (signs >= 2)
    return (n > 0) & (n <= 6) & (short | sparse)  # the length decides for almost every line before the rest is looked at


def dehyphenate(c: Column | str) -> Column:
    """Words cut by a hyphen at a line's end are joined."""
    return F.regexp_replace(_col(c), r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", "$1$2")


def collapse_whitespace(c: Column | str) -> Column:
    out = F.regexp_replace(_col(c), r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r" +\n", "\n")
    return strip(F.regexp_replace(out, r"\n +", "\n"))


def drop_page_breaks(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), r"\n{4,}", "\n\n"))


def estimate_tokens(c: Column | str) -> Column:
    """Tokens by character class: 2.5 Bengali or 4 other characters make one, rounded down."""
    n = bangla_count(c)
    return F.floor(n / 2.5 + (F.length(_col(c)) - n) / 4.0).cast("int")


def footer_page(c: Column | str) -> Column:
    """N of a line ``N / M``, null where the line is none or N is 0."""
    n = F.translate(F.regexp_extract(strip(c), r"^([0-9০-৯]+)\s*/\s*[0-9০-৯]+$", 1), BENGALI_DIGITS, "0123456789").try_cast("int")
    return F.when(n > 0, n)


def is_footer_url(c: Column | str) -> Column:
    return _col(c).rlike("|".join(FOOTER_DOMAINS))


def is_date_line(c: Column | str) -> Column:
    return strip(c).rlike(r"^[0-9০-৯]{2}/[0-9০-৯]{2}/[0-9০-৯]{4}$")


def is_copyright_line(c: Column | str) -> Column:
    out = F.lit(False)
    for phrase in COPYRIGHT_PHRASES:
        out = out | _col(c).contains(phrase)
    return out


def strip_date_prefix(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"^(?U)\s*\d{2}/\d{2}/\d{4}\s+", "")


def volume_of(filename: Column | str) -> Column:
    return F.regexp_extract(_col(filename), r"act-print-(\d+)", 1)


def is_clause_identifier(c: Column | str) -> Column:
    """Digits up to three, one consonant, up to three small letters, or one of the special marks."""
    text = _col(c)
    return F.lower(text).isin(*CLAUSE_SPECIALS) | text.rlike(r"^(?:[0-9০-৯]{1,3}|[\x{0995}-\x{09B9}]|[a-z]{1,3})$")


def nonempty(c: Column | str) -> Column:
    """The value, null for an empty one."""
    return F.nullif(_col(c), F.lit(""))


def words(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), r"(?U)\s+"), lambda w: w != "")


def rewrite_needed(question: Column | str) -> Column:
    """A question of fewer than five words that names no provision."""
    q = _col(question)
    return (F.size(words(q)) < 5) & ~F.lower(q).contains("article") & ~F.lower(q).contains("section") & ~q.contains("ধারা")


def accept_rewrite(question: Column | str, rewritten: Column | str) -> Column:
    r, q = _col(rewritten), _col(question)
    return F.when((F.length(r) > 0) & (F.length(r) > 0.3 * F.length(q)), r).otherwise(q)


def chunk_id(source: Column | str, section: Column | str, index: Column | str) -> Column:
    return F.concat(_col(source), F.lit(":s"), F.coalesce(_col(section), F.lit("")), F.lit(":c"), _col(index).cast("string"))


def split_sentences(c: Column | str) -> Column:
    """Sentences by danda, what follows the last one as the last item; without a danda by ``.``, ``!`` or ``?`` and a blank."""
    text = _col(c)
    runs = F.regexp_extract_all(text, F.lit(r"([^।\n]+।)"), F.lit(1))
    rest = strip(F.regexp_replace(text, r"[^।\n]+।", ""))
    marked = F.concat(runs, F.array(rest))
    plain = F.split(text, r"(?<=[.!?])[\s\p{Z}\x{1C}-\x{1F}\x{85}]+")
    # without a danda the search for one would start again at every character
    out = F.when(text.contains("।"), F.when(F.size(runs) > 0, marked).otherwise(plain)).otherwise(plain)
    return F.filter(F.transform(out, strip), lambda s: s != "")
