"""Filling containers of fixed capacity, by minimum bin slack over the histogram of item lengths.

The lengths that occur are at most the capacity, so the histogram is bounded whatever the number of items. For each
container the largest item left is placed and bitset subset-sum dynamic programming over the available lengths finds
the fullest combination with it. A combination is used as often as the counts allow, so that the number of
combinations never exceeds the number of lengths; items are then given their places in parallel, by rank in length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Salts over which the ranks of one length are counted, so that a common length is no single task.
SALTS = 64
# Fixed value: how texts are cut before byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """item, tokens of every distinct row; a null or empty text has 0 tokens. Only numbers are shuffled."""
    path = vocabulary or f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"item": pdf["item"], "mark": pdf["mark"], "tokens": [len(own.encode_ordinary(t)) if t else 0 for t in pdf["unit"]]})

    rows = df.select(F.col(key).alias("item"), F.col(text).alias("unit"), F.xxhash64(text).alias("mark"))
    item = dict(rows.dtypes)["item"]
    return rows.mapInPandas(count, f"item {item}, mark bigint, tokens long").distinct().select("item", "tokens")


def _fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """Multiplicities of available lengths whose sum is the largest that fits the room, large lengths first."""
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # reach before the step, length, times
    for size in lengths:
        if size > room:
            continue
        left, times = min(counts[size], room // size), 1
        while left > 0:
            take = min(times, left)
            steps.append((reach, size, take))
            reach = (reach | reach << size * take) & mask
            left -= take
            times *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, size, take in reversed(steps):
        if not before >> total & 1:
            total -= size * take
            used[size] = used.get(size, 0) + take
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many containers take each, so that every item of the histogram has a place."""
    counts = {k: n for k, n in histogram.items() if n > 0 and 0 < k <= capacity}
    out: list[tuple[dict[int, int], int]] = []
    lengths = sorted(counts, reverse=True)
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        used = _fullest(capacity - largest, [s for s in lengths if counts[s] > 0], counts)
        counts[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        times = min(counts[s] // n for s, n in used.items())
        for s, n in used.items():
            counts[s] -= n * times
        out.append((used, times))
        lengths = [s for s in lengths if counts[s] > 0]
    return out


def pack(items: DataFrame, kind: str, capacity: int) -> DataFrame:
    """container_kind, item, piece_no, tokens, container_no for items (item, tokens).

    Only an item above the capacity is split, into full pieces and one rest; each piece but the rest fills a container
    of its own. An item without tokens needs no room: container_no is null. Containers are numbered from 1; the
    numbers of full pieces follow those of the planned containers.
    """
    if capacity is None or capacity < 1:
        raise ValueError("a container holds at least one token")
    full = F.floor(F.col("tokens") / capacity)
    rest = F.col("tokens") - full * capacity
    cut = items.where("tokens is not null").withColumn("full", F.when(F.col("tokens") > capacity, full).otherwise(F.lit(0))).withColumn("size", F.when(F.col("tokens") > capacity, rest).otherwise(F.col("tokens")))
    pieces = cut.where("size > 0").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    spread = pieces.groupBy("size", "salt").agg(F.count("*").alias("n"))
    cells = spread.toPandas()  # at most capacity x SALTS rows
    cells = cells.sort_values(["size", "salt"]) if len(cells) else cells
    histogram = cells.groupby("size")["n"].sum().to_dict() if len(cells) else {}
    offsets: dict[int, np.ndarray] = {}
    for size, part in cells.groupby("size"):
        at = np.zeros(SALTS + 1, dtype="int64")
        at[part["salt"].to_numpy(dtype="int64") + 1] = part["n"]
        offsets[int(size)] = at.cumsum()
    starts: dict[int, list[list[int]]] = {}
    base = 0
    for used, times in plan({int(k): int(v) for k, v in histogram.items()}, capacity):
        for size, n in used.items():
            mine = starts.setdefault(size, [[0], [], []])
            mine[1].append(base)
            mine[2].append(n)
            mine[0].append(mine[0][-1] + n * times)
        base += times
    tables = {s: tuple(np.array(x, dtype="int64") for x in v) for s, v in starts.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size, rank = pdf["size"].to_numpy(), pdf["rank"].to_numpy()
            salt = pdf["salt"].to_numpy()
            no = np.zeros(len(pdf), dtype="int64")
            for s in np.unique(size):
                who = np.flatnonzero(size == s)
                at, bases, times = tables[int(s)]
                r = rank[who] - 1 + offsets[int(s)][salt[who]]
                k = np.searchsorted(at, r, side="right") - 1
                no[who] = bases[k] + (r - at[k]) // times[k] + 1
            yield pdf[["item", "full", "tokens"]].assign(piece_no=(pdf["full"] + 1).astype("int32"), size=size, container_no=no)

    order = Window.partitionBy("size", "salt").orderBy("item", "tokens")
    ranked = pieces.select("item", "tokens", "full", "size", "salt", F.row_number().over(order).cast("long").alias("rank"))
    item = dict(items.dtypes)["item"]
    placed = ranked.mapInPandas(place, f"item {item}, full long, tokens long, piece_no int, size long, container_no long")
    whole = cut.where("full > 0")
    # containers of full pieces: numbered by the item's own running total over the salts
    whole = whole.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    totals = whole.groupBy("salt").agg(F.sum("full").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("salt", "before")
    run = F.coalesce(F.sum("full").over(Window.partitionBy("salt").orderBy("item", "tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = whole.withColumn("run", run).join(totals, "salt").select("item", F.posexplode(F.sequence(F.lit(1), F.col("full"))).alias("i", "j"), "run", "before")
    big = parts.select("item", (F.col("i") + 1).cast("int").alias("piece_no"), F.lit(capacity).cast("long").alias("tokens"), (F.col("run") + F.col("before") + F.col("j") + base).cast("long").alias("container_no"))
    small = placed.select("item", "piece_no", F.col("size").alias("tokens"), "container_no")
    none = cut.where("tokens = 0").select("item", F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("long").alias("container_no"))
    out = small.unionByName(big).unionByName(none)
    return out.select(F.lit(kind).alias("container_kind"), "item", "piece_no", "tokens", "container_no")
