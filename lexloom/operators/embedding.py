"""Embedding behind a small interface, with a deterministic stand-in that needs no model.

The stand-in hashes words into a unit vector. A real model plugs in as a function of a list of
texts, loaded once per Python worker.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRY_LENGTH = 6000


def hashed_vectors(texts: list[str | None], size: int) -> np.ndarray:
    """Unit vectors of hashed word counts; a text without words gives the first axis."""
    out = np.zeros((len(texts), size))
    for row, t in zip(out, texts):
        for w, n in Counter((t or "").lower().split()).items():
            h = zlib.crc32(w.encode())
            row[h % size] += n if h >> 16 & 1 else -n
        if not row.any():
            row[0] = 1.0
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def hashed(text: Column | str, size: int = 64) -> Column:
    """Column of hashed unit vectors."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(hashed_vectors(s.tolist(), size)))

    return run(F.col(text) if isinstance(text, str) else text)


def embed(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], output: str = "embedding", batch: int = 32, attempts: int = 3) -> DataFrame:
    """Add unit vectors by a model. A batch that fails is tried again with texts cut to 6000 characters; then the error is raised."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            texts = [t if t and t.strip() else " " for t in s]
            out: list[np.ndarray] = []
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                for turn in range(attempts):
                    try:
                        v = np.asarray(model(some), dtype=np.float32)
                        break
                    except Exception:
                        if turn == attempts - 1:
                            raise
                        some = [t[:RETRY_LENGTH] for t in some]
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                out += list(v)
            yield pd.Series([x.tolist() for x in out])

    return df.withColumn(output, run(F.col(text)))
