"""Exact cosine retrieval with filters on nested metadata, fallbacks and fusion with keyword scores.

Queries are a small set; they go to every task behind a check of their number. Beyond the bound they go through in
blocks, so that what is sent never grows with the data. Vectors are multiplied as matrices and never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import nonempty

TOP_K, SCORE_THRESHOLD, RELAXED_THRESHOLD = 8, 0.3, 0.15
#: Most queries broadcast at once: 10,000 vectors of 1,024 doubles are 80 MB.
MOST_QUERIES = 10_000
#: Most words of queries sent at once, about 100 MB with their lists.
MOST_QUERY_WORDS = 1_000_000
TEXT_FIELDS = ("act_name", "document_type", "language", "source_pdf")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null where one has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def condition(key: str, value, chunk_type: str = "chunk_type", metadata: str = "metadata", hierarchy: str = "hierarchy") -> Column | None:
    """Predicate of one filter, None for a key that is not known: equality on the hierarchy, the year and flags of validation, containment else."""
    if key.startswith("hierarchy."):
        return F.col(f"{hierarchy}.{key.partition('.')[2]}") == str(value)
    if key == "year":
        return F.col(f"{metadata}.act_year") == int(value)
    if key == "chunk_type":
        return F.col(chunk_type).contains(str(value))
    if key in TEXT_FIELDS:
        return F.col(f"{metadata}.{key}").contains(str(value))
    if key.startswith("validation."):
        return F.coalesce(F.try_element_at("validation", F.lit(key.partition(".")[2])), F.lit(False)) == bool(value)
    return None


def filtered(points: DataFrame, filters: dict | None) -> tuple[DataFrame, list[str]]:
    """Points that satisfy all known filters, and the keys that were ignored."""
    made = {k: condition(k, v) for k, v in (filters or {}).items()}
    known = [c for c in made.values() if c is not None]
    return (points.where(reduce(lambda a, b: a & b, known)) if known else points), [k for k, c in made.items() if c is None]


def top_k(points: DataFrame, query: list[float], k: int = TOP_K, threshold: float = SCORE_THRESHOLD, point_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best points of one query with their score and rank; ties go to the smaller id. A k or threshold of 0 or less means the default."""
    k, threshold = (k if k > 0 else TOP_K), (threshold if threshold > 0 else SCORE_THRESHOLD)
    given = F.array(*[F.lit(float(x)) for x in query])
    best = points.withColumn("score", F.round(cosine(F.col(vector), given), 6)).where(F.col("score") >= threshold).orderBy(F.desc("score"), point_id).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), point_id)))


def top_k_batch(points: DataFrame, queries: DataFrame, query_id: str = "qid", k: str | int = TOP_K, threshold: float = SCORE_THRESHOLD, point_id: str = "vec_id", vector: str = "embedding", query_vector: str = "query_vector") -> DataFrame:
    """The best points of many queries: query columns, point columns, score, rank. ``k`` may be a column of the queries.

    Points pass once, as matrices; every batch keeps the k best of each query, so that a shuffle sees a few rows per
    batch and query, never all pairs. Points with the same id count once; ties go to the smaller id. Vectors that are
    null or without length match nothing. Queries beyond the broadcast bound are answered in blocks.
    """
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"), limit.cast("int").alias("k")).limit(MOST_QUERIES + 1).toPandas()
    if len(asked) > MOST_QUERIES:
        blocks = 2 * -(-queries.count() // MOST_QUERIES)
        parts = [queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i) for i in range(blocks)]
        return reduce(DataFrame.unionByName, [top_k_batch(points, p, query_id, k, threshold, point_id, vector, query_vector) for p in parts])
    asked = asked[asked["v"].notna()]
    names, ks = asked["q"].tolist(), asked["k"].fillna(0).astype(int).tolist()
    wanted = np.array([np.asarray(v, dtype=np.float64) for v in asked["v"]])
    if len(wanted):
        length = np.linalg.norm(wanted, axis=1, keepdims=True)
        wanted = np.divide(wanted, length, out=np.full_like(wanted, np.nan), where=length > 0)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["v"].notna()]
            out: list[tuple] = []
            if len(pdf) and len(wanted):
                own = np.array([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
                length = np.linalg.norm(own, axis=1, keepdims=True)
                scores = np.round(np.divide(own, length, out=np.full_like(own, np.nan), where=length > 0) @ wanted.T, 6)
                ids = pdf["i"].to_numpy()
                for j, (name, most) in enumerate(zip(names, ks)):
                    at = np.flatnonzero(scores[:, j] >= threshold)
                    if len(at) > most:
                        at = at[np.lexsort((ids[at], -scores[at, j]))]
                        at = at[~pd.Series(ids[at]).duplicated().to_numpy()][:most]  # the best of each id, before the cut
                    out += [(name, ids[i], scores[i, j]) for i in at]
            yield pd.DataFrame(out, columns=["q", "i", "score"])

    rows = points.select(F.col(point_id).alias("i"), F.col(vector).alias("v"))
    kinds = dict(queries.dtypes)[query_id], dict(rows.dtypes)["i"]
    few = rows.mapInPandas(best, f"q {kinds[0]}, i {kinds[1]}, score double").groupBy("q", "i").agg(F.max("score").alias("score"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "i")))
    found = ranked.withColumnsRenamed({"q": query_id, "i": point_id}).join(queries, query_id).where(F.col("rank") <= limit)
    payload = points.join(found.select(point_id).distinct(), point_id, "left_semi").dropDuplicates([point_id])
    return found.join(payload, point_id)


def by_act(points: DataFrame, act: str, vector: list[float], k: int = 0, threshold: float = 0.0, point_id: str = "vec_id") -> DataFrame:
    """The best points of one act, twice as many as usual unless ``k`` says otherwise."""
    return top_k(filtered(points, {"act_name": act})[0], vector, k if k > 0 else 2 * TOP_K, threshold, point_id)


def by_section(points: DataFrame, section: str, vector: list[float], act: str = "", k: int = 0, threshold: float = 0.0, point_id: str = "vec_id") -> DataFrame:
    """The best points of a section, of any act or of one."""
    return top_k(filtered(points, {"hierarchy.section": section} | ({"act_name": act} if act else {}))[0], vector, k, threshold, point_id)


def first_or_relaxed(ranked: DataFrame, threshold: float, query_id: str = "qid") -> DataFrame:
    """Of results ranked down to a relaxed threshold: those that reach the first one, and all of a query that has none.

    The first ones are the best ranks of the same list, so one pass over the points serves both thresholds.
    """
    best = F.max("score").over(Window.partitionBy(query_id))
    return ranked.withColumn("_best", best).where((F.col("score") >= threshold) | (F.col("_best") < threshold)).drop("_best")


def with_fallback(primary: DataFrame, fallback: DataFrame, query_id: str = "qid") -> DataFrame:
    """The primary results, and the fallback's for queries that have none."""
    return primary.unionByName(fallback.join(primary.select(query_id).distinct(), query_id, "left_anti"))


def to_chunks(points: DataFrame) -> DataFrame:
    """Retrieved points in the shape of chunks: empty texts and names take their stand-ins."""
    name = F.coalesce(nonempty("metadata.act_name"), nonempty("metadata.bangla_name"), F.lit(""))
    return points.withColumn("act_name", name).withColumn("year", F.coalesce(F.col("metadata.act_year"), F.lit(0)))


def keyword_top_k(documents: DataFrame, queries: DataFrame, key: str, text: str, k: int = TOP_K, query_id: str = "qid", query_text: str = "query", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of each query by BM25: query_id, key, keyword_score.

    Statistics are counted over all documents, for the queries' words only. Then documents pass once, as sparse lists of (document, word, query), and
    every batch keeps the k best of each query: a common word makes no pairs of all documents with all queries. Parts
    are summed as whole millionths, so that the order of the sum does not show; ties go to the smaller key. A null text
    holds no word. Queries beyond the bound are answered in blocks.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    asked = queries.select(F.col(query_id).alias("q"), F.array_distinct(split(query_text)).alias("words")).limit(MOST_QUERIES + 1).toPandas()
    asked_words = sum(len(ws) for ws in asked["words"] if ws is not None)
    if len(asked) > MOST_QUERIES or asked_words > MOST_QUERY_WORDS and len(asked) > 1:
        blocks = 2 * -(-max(queries.count(), 1) // MOST_QUERIES) if len(asked) > MOST_QUERIES else 2 * -(-asked_words // MOST_QUERY_WORDS)
        parts = [queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i) for i in range(blocks)]
        return reduce(DataFrame.unionByName, [keyword_top_k(documents, p, key, text, k, query_id, query_text, k1, b) for p in parts])
    terms = sorted({w for ws in asked["words"] if ws is not None for w in ws})
    place = {w: i for i, w in enumerate(terms)}
    pairs = sorted((place[w], j) for j, ws in enumerate(asked["words"]) if ws is not None for w in ws)
    askers = np.array([j for _, j in pairs], dtype=np.int64)  # the queries of each word, one word after the other
    first = np.searchsorted(np.array([t for t, _ in pairs], dtype=np.int64), np.arange(len(terms) + 1))
    docs = documents.select(F.col(key).alias("i"), split(text).alias("words")).where("words is not null")
    total = docs.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    wanted = documents.sparkSession.createDataFrame([(w,) for w in terms], "word string")
    counted = docs.select(F.explode(F.array_distinct("words")).alias("word")).join(F.broadcast(wanted), "word").groupBy("word").agg(F.count("*").alias("df")).toPandas()
    have = np.zeros(len(terms))
    for w, n in zip(counted["word"], counted["df"]):
        have[place[w]] = n
    n_docs, mean = total["n"], total["mean"] or 1.0
    idf = np.log(1 + (n_docs - have + 0.5) / (have + 0.5))
    names = asked["q"].tolist()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            out: list[tuple] = []
            for at in range(0, len(whole), 1000):
                pdf = whole.iloc[at : at + 1000]
                held = [Counter(t for w in ws if (t := place.get(w)) is not None) for ws in pdf["words"]]
                doc = np.repeat(np.arange(len(pdf)), [len(h) for h in held])
                term = np.array([t for h in held for t in h], dtype=np.int64)
                tf = np.array([n for h in held for n in h.values()], dtype=float)
                length = pdf["words"].map(len).to_numpy(dtype=float)[doc]
                part = np.round(idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)) * 1e6)
                many = first[term + 1] - first[term]
                ends = np.cumsum(many)
                who = askers[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[term] - (ends - many), many)]
                keys, at_key = np.unique(np.repeat(doc, many) * len(names) + who, return_inverse=True)
                scores = np.bincount(at_key, weights=np.repeat(part, many), minlength=len(keys))
                ids, asker = pdf["i"].to_numpy()[keys // max(len(names), 1)], keys % max(len(names), 1)
                order = np.lexsort((ids, -scores, asker))
                order = order[scores[order] > 0]
                starts = np.searchsorted(asker[order], np.arange(len(names)))
                order = order[np.arange(len(order)) - starts[asker[order]] < k]
                out += [(names[asker[i]], ids[i], scores[i] / 1e6) for i in order]
            yield pd.DataFrame(out, columns=["q", "i", "keyword_score"])

    kinds = dict(queries.dtypes)[query_id], dict(docs.dtypes)["i"]
    few = docs.mapInPandas(best, f"q {kinds[0]}, i {kinds[1]}, keyword_score double").groupBy("q", "i").agg(F.max("keyword_score").alias("keyword_score"))
    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("keyword_score"), "i"))).where(F.col("n") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("i").alias(key), "keyword_score")


def fuse(dense: DataFrame, sparse: DataFrame, query_id: str, key: str, k: int = 6, constant: int = 60, depth: int = 50) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (columns score and keyword_score): query_id, key, fused, rank."""
    rank = lambda df, c: df.withColumn("r", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(c), key))).where(F.col("r") <= depth).select(query_id, key, (1.0 / (constant + F.col("r"))).alias("part"))
    fused = rank(dense, "score").unionByName(rank(sparse, "keyword_score")).groupBy(query_id, key).agg(F.round(F.sum("part"), 6).alias("fused"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("fused"), key))).where(F.col("rank") <= k)
