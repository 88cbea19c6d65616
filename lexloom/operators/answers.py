"""Citations, references and contexts of retrieved chunks, and answers behind a small interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import nonempty

SEPARATOR = "\n\n---\n\n"
# Openings of failed answers, by language.
NOT_FOUND = {"bn": "এই প্রশ্নের জন্য সংগ্রহে কোনো বিধান পাওয়া যায় নাই।", "en": "No provision in the collection was found for this question."}
FAILED = {"bn": "একটি ত্রুটি ঘটেছে: ", "en": "An error occurred: "}


def hierarchy_citation(name: Column, hierarchy: Column) -> Column:
    part = lambda label, c, close="": F.when(nonempty(c).isNotNull(), F.concat(F.lit(label), c, F.lit(close)))
    return F.concat_ws(", ", nonempty(name), part("Article ", hierarchy["article"]), part("Section ", hierarchy["section"]), part("Clause (", hierarchy["clause"], ")"), part("Sub-clause (", hierarchy["sub_clause"], ")"))


def ordered(column: Column, by: str = "rank") -> Column:
    """Values of a group in the order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), column.alias("v")))), lambda x: x["v"])


def citations(chunks: DataFrame, query_id: str) -> DataFrame:
    """Distinct citations of each query in order of rank; a chunk without one is cited by its place."""
    own = F.coalesce(nonempty("citation"), nonempty(hierarchy_citation(F.col("act_name"), F.col("hierarchy"))))
    return chunks.withColumn("_c", own).groupBy(query_id).agg(F.filter(F.array_distinct(ordered(F.col("_c"))), lambda c: c.isNotNull()).alias("citations"))


def references(chunks: DataFrame, query_id: str, refs: str = "law_refs") -> DataFrame:
    """Distinct references of each query, by kind and target, in order of rank."""
    return chunks.groupBy(query_id).agg(F.array_distinct(F.flatten(ordered(F.coalesce(F.col(refs), F.array().cast("array<struct<ref_type:string,target:string>>"))))).alias("references"))


def context_block(number: Column, citation: Column, score: Column, text: Column) -> Column:
    head = F.concat_ws(" | ", F.concat(F.lit("[Chunk "), number.cast("string"), F.lit("]")), nonempty(citation), F.when(score > 0, F.concat(F.lit("relevance="), F.format_string("%.2f", score))))
    return F.concat(head, F.lit("\n"), F.coalesce(text, F.lit("")))


def contexts(chunks: DataFrame, query_id: str, most: int | str = 8) -> DataFrame:
    """The context of each query from its first chunks, and how many were retrieved."""
    limit = F.col(most) if isinstance(most, str) else F.lit(most)
    block = F.when(F.col("rank") <= limit, context_block(F.col("rank"), F.col("citation"), F.col("score"), F.col("text")))
    return chunks.withColumn("_b", block).groupBy(query_id).agg(F.array_join(F.filter(ordered(F.col("_b")), lambda b: b.isNotNull()), SEPARATOR).alias("context"), F.count("*").alias("retrieved"))


def legacy_block(law: Column, year: Column, section: Column, chapter: Column, score: Column, text: Column) -> Column:
    """A chunk in the older format: law, year, section, chapter and relevance in brackets, then the text."""
    wrap = lambda before, c, after: F.when(nonempty(c).isNotNull(), F.concat(F.lit(before), c, F.lit(after)))
    head = F.concat_ws(" | ", nonempty(law), wrap("(", year, ")"), wrap("ধারা ", section, ""), nonempty(chapter), F.when(score.isNotNull(), F.concat(F.lit("relevance="), F.format_string("%.2f", score))))
    return F.concat(F.lit("["), head, F.lit("]\n"), F.trim(text))


def confidence(n: Column, summary: bool = False) -> Column:
    if summary:
        return F.when(n >= 10, "high").otherwise("medium")
    return F.when(n >= 5, "high").when(n >= 2, "medium").otherwise("low")


def fill_prompt(template: Column, user_type: Column, context: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{user_type}"), user_type), F.lit("{context}"), context)


def prompt_of(routes: Column, language: Column, templates: dict[tuple[str, str], str], default: str = "legal_qa") -> Column:
    """Template of a route and language; another language falls back on English, another route on the default's."""
    pairs = [F.lit(x) for (r, lang), t in templates.items() for x in (f"{r}/{lang}", t)]
    table = F.create_map(*pairs)
    get = lambda r, lang: table[F.concat(r, F.lit("/"), lang)]
    return F.coalesce(get(routes, language), get(routes, F.lit("en")), get(F.lit(default), language), get(F.lit(default), F.lit("en")))


def extractive(prompt: str, question: str) -> tuple[str, int, int]:
    """Stand-in for a model: the first sentence of every chunk of the context."""
    parts = []
    for block in prompt.split(SEPARATOR):
        body = block.partition("\n")[2].strip()
        cut = min((body.find(m) for m in ("।", ". ", "? ") if body.find(m) >= 0), default=len(body) - 1)
        if body:
            parts.append(body[: cut + 1].strip())
    return " ".join(parts), len(prompt.split()), sum(len(p.split()) for p in parts)


def answer(df: DataFrame, providers: list[Callable[[str, str], tuple[str, int, int]]] = (extractive,), prompt: str = "prompt", question: str = "question", language: str = "language") -> DataFrame:
    """Add answer, prompt_tokens, completion_tokens and error. Providers are tried in order; if all fail, the last error is the answer.

    Where the prompt is null there is nothing to answer from: no provider is asked, and the answer says so.
    """
    chain = list(providers)

    @F.pandas_udf("struct<answer:string,prompt_tokens:int,completion_tokens:int,error:string>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ps, qs, ls in parts:
            out = []
            for p, q, lang in zip(ps, qs, ls):
                error = None
                if p is None:
                    out.append((NOT_FOUND.get(lang, NOT_FOUND["en"]), 0, 0, None))
                    continue
                for provider in chain:
                    try:
                        text, used, made = provider(p, q or "")
                        out.append((text.strip(), used, made, None))
                        break
                    except Exception as e:
                        error = str(e)
                else:
                    out.append((FAILED.get(lang, FAILED["en"]) + (error or ""), 0, 0, error))
            yield pd.DataFrame(out, columns=["answer", "prompt_tokens", "completion_tokens", "error"])

    return df.withColumn("_a", run(prompt, question, language)).select("*", "_a.*").drop("_a")
