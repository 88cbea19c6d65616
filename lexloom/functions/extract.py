"""Metadata of statutes out of their text, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import bengali_to_int, document_language, is_mostly_bangla, nonempty, strip, strip_date_prefix, volume_of

# Patterns of the corpus' conventions.
ACT_YEAR_NUMBER = r"[(（]\s*([১২][০-৯]{3})\s*সনের?\s*([০-৯]+)\s*নং\s*(?:আইন|অধ্যাদেশ)\s*[)）]"
ENGLISH_ACT = r"(?i)Act\s+No\.?\s*(\d+)\s*of\s*(\d{4})"
BANGLA_DATE = r"\[\s*([০-৯]+)\s+([\x{0980}-\x{09FF}]+),\s*([১২][০-৯]{3})\s*\]"
ENGLISH_DATE = r"\[\s*(\d{1,2})(?:st|nd|rd|th)?\s+([\p{L}\p{N}_]+),?\s*(\d{4})\s*\]"
AMENDMENT = r"(?d)(.+?)\s+এর\s+অধিকতর\s+সংশোধনকল্পে\s+প্রণীত\s+আইন"
CROSS_REFERENCE = r"([১২][০-৯]{3})\s*সনের?\s*([০-৯]+)\s*নং\s*(আইন|অধ্যাদেশ)"
ORDER = r"(?i)President'?s?\s*Order\s*(?:\(?P\.?O\.?\s*)?No\.?\s*(\d+)\s*of\s*(\d{4})"
ARTICLE = r"(?i)(?:Article|অনুচ্ছেদ)\s+([0-9০-৯]+[A-Za-z]*)"
SECTION = r"(?:SECTION|Section|section)\s+([0-9০-৯]+[A-Za-z]*)"
RULE = r"(?i)(বিধিমালা|Rules?|Regulations?)(?![\p{L}\p{N}_])"
LAW_WORDS = ("আইন", "অধ্যাদেশ", "বিধিমালা")


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n)


def act_year(text: Column) -> Column:
    english = _group(text, ENGLISH_ACT, 2).try_cast("int")
    return F.when(text.rlike(ACT_YEAR_NUMBER), bengali_to_int(_group(text, ACT_YEAR_NUMBER, 1))).otherwise(F.coalesce(english, F.lit(0)))


def act_number(text: Column) -> Column:
    return F.when(text.rlike(ACT_YEAR_NUMBER), bengali_to_int(_group(text, ACT_YEAR_NUMBER, 2)).cast("string")).otherwise(_group(text, ENGLISH_ACT, 1))


def publication_date(text: Column) -> Column:
    return F.when(text.rlike(BANGLA_DATE), F.concat(_group(text, BANGLA_DATE, 1), F.lit(" "), _group(text, BANGLA_DATE, 2), F.lit(", "), _group(text, BANGLA_DATE, 3))).otherwise("")


def publication_date_en(text: Column) -> Column:
    return F.when(text.rlike(ENGLISH_DATE), F.concat(_group(text, ENGLISH_DATE, 1), F.lit(" "), _group(text, ENGLISH_DATE, 2), F.lit(", "), _group(text, ENGLISH_DATE, 3))).otherwise("")


def _tidy(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s{2,}", " "))


def _head(text: Column, lines: int) -> Column:
    return F.transform(F.slice(F.split(text, "\n"), 1, lines), lambda x: strip_date_prefix(strip(x)))


def _law_word(line: Column) -> Column:
    return line.contains(LAW_WORDS[0]) | line.contains(LAW_WORDS[1]) | line.contains(LAW_WORDS[2])


def bangla_name(header: Column) -> Column:
    """The first title line with a year among the first 30 lines, else the first title line."""
    titles = F.filter(_head(header, 30), lambda x: (F.length(x) >= 10) & _law_word(x) & is_mostly_bangla(x, 0.6))
    dated = F.filter(titles, lambda x: x.rlike("[১২][০-৯]{3}"))
    return F.coalesce(_tidy(F.try_element_at(dated, F.lit(1))), F.try_element_at(titles, F.lit(1)), F.lit(""))


def english_name(header: Column, fallback: Column) -> Column:
    lines = _head(header, 20)
    first = F.filter(lines, lambda x: (F.length(x) >= 10) & ~is_mostly_bangla(x, 0.2) & x.rlike(r"Act[,，]\s*(19|20)\d{2}|Act\s*$"))
    second = F.filter(lines, lambda x: (F.length(x) > 20) & ~is_mostly_bangla(x, 0.2) & (x.contains("Act") | x.contains("Ordinance")) & x.rlike(r"(19|20)\d{2}"))
    return F.coalesce(_tidy(F.try_element_at(first, F.lit(1))), _tidy(F.try_element_at(second, F.lit(1))), fallback)


def amendment_of(text: Column) -> Column:
    """What an amending law amends: the phrase before its formula, else a cited law before the word for amendment."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 15), strip)
    cited = F.filter(lines, lambda x: x.contains("সংশোধন") & (x.contains("আইন") | x.contains("অধ্যাদেশ")) & x.rlike(r"(?d)[(（].*?সনের.*?নং.*?আইন.*?[)）]") & (F.length(F.split(x, r"\s*সংশোধন")[0]) > 0))
    before = F.split(F.try_element_at(cited, F.lit(1)), r"\s*সংশোধন")[0]
    return F.when(text.rlike(AMENDMENT), _tidy(_group(text, AMENDMENT, 1))).otherwise(F.coalesce(_tidy(before), F.lit("")))


def document_type(text: Column, english: Column) -> Column:
    head, start = F.substring(text, 1, 1000), F.substring(text, 1, 500)
    amends = english.contains("Amendment") | head.contains("সংশোধন")
    return (
        F.when(amends & head.contains("আইন"), "Amendment Act")
        .when(amends & head.contains("অধ্যাদেশ"), "Amendment Ordinance")
        .when(head.contains("অধ্যাদেশ"), "Ordinance")
        .when(head.contains("বিধিমালা"), "Rule")
        .when(start.contains("Ordinance"), "Ordinance")
        .otherwise("Act")
    )


def references(text: Column) -> Column:
    """Distinct references in order of kind and place: array of (ref_type, target), the first of a target wins."""

    def found(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def made(kind: str, items: Column, target) -> Column:
        return F.transform(items, lambda x, i: F.struct(F.lit(kind).alias("ref_type"), target(x, i).alias("target")))

    years, numbers, kinds = (found(CROSS_REFERENCE, n) for n in (1, 2, 3))
    laws = F.transform(
        years,
        lambda y, i: F.struct(
            F.when(F.get(kinds, i) == "আইন", "act").otherwise("ordinance").alias("ref_type"),
            F.concat(bengali_to_int(y).cast("string"), F.lit(" সনের "), bengali_to_int(F.get(numbers, i)).cast("string"), F.lit(" নং "), F.get(kinds, i)).alias("target"),
        ),
    )
    order_years = found(ORDER, 2)
    every = F.concat(
        laws,
        made("order", found(ORDER, 1), lambda x, i: F.concat(F.lit("P.O. No. "), x, F.lit(" of "), F.get(order_years, i))),
        made("article", found(ARTICLE, 1), lambda x, i: F.concat(F.lit("Article "), x)),
        made("section", found(SECTION, 1), lambda x, i: F.concat(F.lit("Section "), x)),
        made("rule", found(RULE, 1), lambda x, i: x),
    )
    targets = F.transform(every, lambda r: r["target"])
    return F.filter(every, lambda r, i: F.array_position(targets, r["target"]) == i + 1)


def article_of(text: Column) -> Column:
    """The first article named in the first 200 characters."""
    return F.regexp_extract(F.substring(text, 1, 200), r"(?i)(?:^|\n|\s)Article\s+([0-9০-৯]+[A-Za-z]?)\s*[.।:)]?", 1)


def inserted_section(text: Column) -> Column:
    """The section that an amendment inserts, by the first of four phrasings."""
    head = F.substring(text, 1, 500)
    tries = (r"নূতন\s+ধারা\s+([০-৯]+[ক-হ]?)", r"নতুন\s+ধারা\s+([০-৯]+[ক-হ]?)", r"ধারা\s+([০-৯]+[ক-হ]?)\s+সন্নিবেশ", r"(?:নূতন|নতুন)\s*Article\s+(\d+[A-Za-z]*)")
    return F.coalesce(*[nonempty(F.regexp_extract(head, p, 1)) for p in tries], F.lit(""))


# Ordinals of chapters, in their order.
ORDINALS = "প্রথম দ্বিতীয় তৃতীয় চতুর্থ পঞ্চম ষষ্ঠ সপ্তম অষ্টম নবম দশম একাদশ দ্বাদশ ত্রয়োদশ চতুর্দশ পঞ্চদশ ষোড়শ সপ্তদশ অষ্টাদশ ঊনবিংশ বিংশ একবিংশ".split()
CHAPTER = r"(?:^|\n)\s*(" + "|".join(ORDINALS) + r")\s*অধ্যায়\s*[\n:]?"


def chapter_of(title: Column) -> Column:
    ordinal = F.regexp_extract(title, CHAPTER, 1)
    return F.when(ordinal != "", F.concat(ordinal, F.lit(" অধ্যায়"))).otherwise("")


def title_without_chapter(title: Column) -> Column:
    return F.when(title.rlike(CHAPTER), strip(F.regexp_replace(title, CHAPTER, ""))).otherwise(title)


def metadata(df, text: str, first_page: str, filename: str):
    """Add the metadata of each document: names, number, year, dates, language, type, amended law, references, volume."""
    body = F.coalesce(F.col(text), F.lit(""))
    header = F.when(F.length(F.col(first_page)) > 0, F.substring(first_page, 1, 2000)).otherwise(F.substring(body, 1, 2000))
    out = df.withColumn("bangla_name", bangla_name(header))
    out = out.withColumn("act_name", english_name(header, F.col("bangla_name")))
    return out.withColumns(
        {
            "act_year": act_year(header),
            "act_number": act_number(header),
            "publication_date": publication_date(header),
            "publication_date_en": publication_date_en(header),
            "language": document_language(header),
            "document_type": document_type(header, F.col("act_name")),
            "amendment_of": amendment_of(header),
            "law_refs": references(body),
            "source_pdf": F.col(filename),
            "volume": volume_of(filename),
        }
    )
