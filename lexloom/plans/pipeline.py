"""The two dataflows end to end: files to points, and questions to answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.extract import metadata
from lexloom.operators import answers, intent, retrieval
from lexloom.operators.chunking import chunk
from lexloom.operators.cleaning import clean
from lexloom.operators.embedding import hashed


def ingest(loaded: DataFrame, budget: int = 1000, lossless: bool = True) -> DataFrame:
    """Chunks of loaded documents (filename, pages, load_error): cleaned, described, parsed, cut. Failed loads give none."""
    rows = loaded.where("load_error is null").select("filename", "pages")
    cleaned = clean(rows, "pages")
    described = metadata(cleaned.withColumn("_first", F.try_element_at("pages", F.lit(1))), "cleaned_text", "_first", "filename")
    return chunk(described.drop("pages", "_first"), "cleaned_text", budget, lossless)


def index(chunks: DataFrame, size: int = 64) -> DataFrame:
    """Valid chunks with their vectors."""
    return chunks.where("valid").withColumn("embedding", hashed("text", size))


def search(
    points: DataFrame, questions: DataFrame, threshold: float = retrieval.SCORE_THRESHOLD, relaxed: float = retrieval.RELAXED_THRESHOLD, size: int = 64,
    filters: dict | None = None, rewriter: Callable[[str], str] | None = None, point_id: str = "point_id",
) -> DataFrame:
    """Retrieved chunks of questions (qid, question): classified, rewritten, routed, embedded; a query without results is relaxed.

    ``filters`` hold for all questions, unknown ones are ignored. ``rewriter`` is asked for questions that need one; its
    answer is taken where it is long enough. A column query_vector of the questions takes the place of the embedding. The
    number of results follows the route; point_id breaks ties. The points pass once for both thresholds.
    """
    q = intent.classify(questions)
    if rewriter is not None:

        @F.pandas_udf("string")
        def rewrite(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else rewriter(x))

        q = intent.apply_rewrite(q.withColumn("_rewrite", rewrite(F.when(F.col("needs_rewrite"), F.col("question")))), "_rewrite").drop("_rewrite")
    if "query_vector" not in questions.columns:
        q = q.withColumn("query_vector", hashed("rewritten_question" if rewriter is not None else "question", size))
    found = retrieval.top_k_batch(retrieval.filtered(points, filters)[0], q, "qid", "top_k", min(threshold, relaxed), point_id)
    return retrieval.first_or_relaxed(found, threshold)


def respond(retrieved: DataFrame, questions: DataFrame, templates: dict[tuple[str, str], str], providers=(answers.extractive,)) -> DataFrame:
    """Responses of questions: context, answer, citations, references, confidence; a question without results is answered low."""
    q = intent.classify(questions)
    built = answers.contexts(retrieved, "qid", "max_chunks")
    out = q.join(built, "qid", "left").join(answers.citations(retrieved, "qid"), "qid", "left").join(answers.references(retrieved, "qid"), "qid", "left")
    prompt = answers.fill_prompt(answers.prompt_of(F.regexp_replace("routed_agent", "_agent$", ""), F.col("language"), templates), F.lit("general"), F.col("context"))
    prompt = F.when(F.length(F.trim("context")) > 0, prompt)  # nothing is asked about an empty context
    n = F.coalesce(F.col("retrieved"), F.lit(0))
    sure = F.when(n == 0, "low").when(F.col("routed_agent") == "act_summary_agent", answers.confidence(n, True)).otherwise(answers.confidence(n))
    return answers.answer(out.withColumn("prompt", prompt), list(providers)).withColumn("confidence", sure)


def chat(points: DataFrame, questions: DataFrame, templates: dict[tuple[str, str], str], providers=(answers.extractive,), **how) -> DataFrame:
    """Responses to questions of any type."""
    return respond(search(points, questions, **how), questions, templates, providers)


def analyze(points: DataFrame, facts: DataFrame, templates: dict[tuple[str, str], str], providers=(answers.extractive,), **how) -> DataFrame:
    """Responses to described facts (qid, question), all taken as facts to analyse."""
    return chat(points, facts.withColumn("query_type", F.lit("fact_analysis")), templates, providers, **how)


def summarize(points: DataFrame, act: str, templates: dict[tuple[str, str], str], providers=(answers.extractive,), **how) -> DataFrame:
    """The summary of one act: only its chunks are searched, by its name."""
    one = points.sparkSession.createDataFrame([(0, act, "act_summary")], "qid long, question string, query_type string")
    return chat(points, one, templates, providers, **({"filters": {"act_name": act}} | how))
