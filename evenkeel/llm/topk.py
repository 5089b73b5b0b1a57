"""Exact top-k inner products on a bit-sliced index.

Each vector component becomes floor(scale * x). Rows are packed into blocks; a block keeps,
for every component, one bitmap per bit of the value above the component's smallest one. The
score of all rows of a block for a query is a sum of these bitmaps, weighted by the bits of
the query's components: full adders over bitmaps reduce the bitmaps of equal weight until
one is left per weight. The k best rows are then picked from the most significant slice
downward, and rows that tie on the boundary are settled exactly by id.

Queries and rows meet block by block: the index of a block of rows, built once, stays where it is
(or goes to a few tasks, where blocks are fewer than `TASKS`), and the packed queries, a fraction of
the rows, are sent to every block. No task holds more than one block of each at a time and no pair of
rows is ever written out. The best k of each block are merged by a window over (query, score, id).

Vectors that are null, empty, or hold a null or non-finite component take no part; nor do
rows with a null id. Shorter vectors count as padded with zeros. Scores are added up without
bound on their bits and the order is exact; a score that no long can hold is shown as the nearest
long. Components beyond 2**56 in size after scaling are set to it. Repeated rows are
rows of their own, except that no row is a candidate for a query of the same id. Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import cut

ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 1 << 15, 256
LARGEST = 1 << 56
TASKS = 64  # meetings are dealt to at least so many tasks, if there are as many
LOW = 62  # bits of the lower part of a score
RESULT = "query_id long, vec_id long, high long, low long"


def bits(rows: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words."""
    packed = np.packbits(rows, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64)


def marked(bitmap: np.ndarray) -> np.ndarray:
    """Positions of the set bits, in order."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def size(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


class Index:
    """Bit slices of a block of vectors (rows by ascending id)."""

    def __init__(self, vectors: np.ndarray):
        self.n = len(vectors)
        low = vectors.min(0)
        above = vectors - low
        self.slices = [[bits((column >> b) & 1 == 1) for b in range(int(top).bit_length())]
                       for column, top in zip(above.T, above.max(0), strict=True)]
        self.low = low
        self.all = bits(np.ones(self.n, bool))

    def pack(self) -> tuple[int, bytes, bytes, bytes]:
        """Number of rows, smallest value and number of slices of each component, and the slices."""
        return (self.n, self.low.astype("<i8").tobytes(), bytes(len(own) for own in self.slices),
                b"".join(piece.tobytes() for own in self.slices for piece in own))

    @classmethod
    def unpack(cls, n: int, low: bytes, depths: bytes, slices: bytes) -> Index:
        self = cls.__new__(cls)
        self.n, self.low = n, np.frombuffer(low, "<i8")
        self.all = bits(np.ones(n, bool))
        pieces = iter(np.frombuffer(slices, np.uint64).reshape(-1, len(self.all)))
        self.slices = [[next(pieces) for _ in range(depth)] for depth in depths]
        return self

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of (score - base), least significant first, and the base.

        A negative weight adds the complement of a slice: -w*s = w*(1-s) - w.
        """
        columns: list[list[np.ndarray]] = []
        base = sum(q * v for q, v in zip(query.tolist(), self.low.tolist(), strict=True))
        for weight, own in zip(query.tolist(), self.slices, strict=True):
            size_, negative = abs(weight), weight < 0
            for b, piece in enumerate(own):
                if size_ and negative:
                    piece = piece ^ self.all
                    base -= size_ << b
                for j in range(size_.bit_length()):
                    if size_ >> j & 1:
                        while len(columns) <= j + b:
                            columns.append([])
                        columns[j + b].append(piece)
        out = []
        k = 0
        while k < len(columns):
            held = columns[k]
            if k + 1 == len(columns) and len(held) > 1:
                columns.append([])
            while len(held) > 2:
                x, y, z = held.pop(), held.pop(), held.pop()
                half = x ^ y
                held.insert(0, half ^ z)
                columns[k + 1].append((x & y) | (half & z))
            if len(held) == 2:
                columns[k + 1].append(held[0] & held[1])
                held = [held[0] ^ held[1]]
            out.append(held[0] if held else np.zeros_like(self.all))
            k += 1
        return out, base

    def top(self, slices: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of the rows surely among the k best, and of those that tie for the rest."""
        sure, tied = np.zeros_like(allowed), allowed
        n_sure = 0
        for piece in reversed(slices):
            here = tied & piece
            n = n_sure + size(here)
            if n > k:
                tied = here
            else:
                sure, n_sure = sure | here, n
                tied = tied & ~piece
                if n == k:
                    return sure, np.zeros_like(tied)
        return sure, tied


def search(ids: np.ndarray, index: Index, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """For each query: its id, the ids of its best rows in the block, and their scores."""
    for qid, query in zip(query_ids.tolist(), queries, strict=True):
        slices, base = index.scores(query)
        own = slice(*np.searchsorted(ids, [qid, qid + 1]).tolist())
        allowed = index.all
        if own.start < own.stop:
            rows = np.ones(index.n, bool)
            rows[own] = False
            allowed = bits(rows)
        sure, tied = index.top(slices, allowed, k)
        found = marked(sure)
        found = np.concatenate([found, marked(tied)[: k - len(found)]])  # ids ascend: ties go to the smaller one
        bit = [(piece[found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1) for piece in slices]
        parts = [sum((x.astype(np.int64) << b for b, x in enumerate(bit[at : at + 60])), np.zeros(len(found), np.int64)).tolist() for at in range(0, len(bit), 60)]
        yield qid, ids[found], [base + sum(p << 60 * i for i, p in enumerate(row)) for row in zip(*parts, strict=True)] if parts else [base] * len(found)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id and v = floor(scale * x) of the vectors that take part."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    top = F.lit(LARGEST).cast("long")
    whole = F.transform(x, lambda e: F.greatest(-top, F.least(top, F.floor(e * F.lit(scale)))))
    return (vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(x.isNotNull() & (F.size(x) > 0) & finite, whole.cast("array<bigint>")).alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, rows_per_block: int = ROWS_PER_BLOCK,
          queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """The k best rows of `rows` (vec_id, v) for each of `queries` (vec_id, v): query_id, rank, vec_id, score."""
    if k < 1:
        raise ValueError("k must be positive")
    spark = rows.sparkSession
    rows, queries = cut(rows), cut(queries)
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n_queries, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = T.StructType().add("query_id", "long").add("rank", "integer").add("vec_id", "long").add("score", "long")
    if not sizes["n"] or not n_queries:
        return spark.createDataFrame([], schema)
    width = max(width, sizes["d"])
    row_blocks, query_blocks = -(-sizes["n"] // rows_per_block), -(-n_queries // queries_per_block)

    def blocked(df: DataFrame, blocks: int, name: str) -> DataFrame:
        """Rows packed into one list per block; which rows share a block does not matter to the result."""
        place = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
        return (df.groupBy(place.alias(name)).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("held"))
                .select(name, F.transform("held", lambda s: s["vec_id"]).alias(f"{name}_ids"),
                        F.transform("held", lambda s: s["v"]).alias(f"{name}_vectors")))

    def matrix(vectors) -> np.ndarray:
        out = np.zeros((len(vectors), width), np.int64)
        for k_, v in enumerate(vectors):
            out[k_, : len(v)] = v
        return out

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r, ids, vectors in zip(batch["r"], batch["r_ids"], batch["r_vectors"], strict=True):
                yield pd.DataFrame([(r, np.asarray(ids, np.int64).tobytes(), *Index(matrix(vectors)).pack())], columns=["r", "ids", "n", "low", "depths", "slices"])

    # Of the two sides only the queries are sent around.
    index = cut(blocked(rows, row_blocks, "r").mapInPandas(build, "r long, ids binary, n long, low binary, depths binary, slices binary"))
    copies = min(query_blocks, max(1, -(-TASKS // row_blocks)))
    left = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)).cast("array<bigint>")))
    right = (blocked(queries, query_blocks, "q").withColumn("g", F.col("q") % copies)
             .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)).cast("array<bigint>"))))
    cells = right.repartition(min(row_blocks * copies, 4096), "r", "g").join(left.hint("shuffle_hash"), ["r", "g"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                found = search(np.frombuffer(row.ids, np.int64), Index.unpack(row.n, row.low, row.depths, row.slices),
                               np.asarray(row.q_ids), matrix(row.q_vectors), k)
                parts = [(np.full(len(a), q), a, [x >> LOW for x in s], [x & ((1 << LOW) - 1) for x in s]) for q, a, s in found]
                yield pd.DataFrame({n: np.concatenate([np.asarray(p[c], np.int64) for p in parts]) for c, n in enumerate(("query_id", "vec_id", "high", "low"))})

    found = cells.mapInPandas(run, RESULT)
    best = W.partitionBy("query_id").orderBy(F.col("high").desc(), F.col("low").desc(), "vec_id")
    least, most = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1)
    score = (F.when(F.col("high") > 1, most).when(F.col("high") < -2, least)
             .otherwise(F.call_function("shiftleft", F.col("high"), F.lit(LOW)).bitwiseOR(F.col("low"))))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", score.alias("score")))
