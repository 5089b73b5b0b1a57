"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of the rotated components make
balanced codes of 64 bits. The code is cut into equal parts, one hash table each; vectors of
the same label whose parts differ in at most `radius` bits share a bucket. Candidates of a
bucket are compared on their original vectors in double precision. At every size of input at
least 8 tables of 8 bits serve, which find every pair of codes within 7 bits and most pairs
farther apart. The sample's vectors are paired with made ones right at the threshold; if more
than `MISS` of these pairs would be missed, 8 more tables cut the code along another order of
its bits, and so on. Where `TABLES` tables do not reach that, as with vectors that hardly
differ from their mean, all vectors of a label meet and no link is lost.

Equal vectors of a label are one class with a size, so copies never meet in a bucket. A
bucket is dealt into blocks by its counted size, and each pair of blocks is a task's row of
bounded size; only counts and a spanning forest of the links leave it, never all pairs.

Vectors that are null, empty, zero or hold null or non-finite components, rows with a null
label and rows with a null id link with nothing; they are returned as they are alone (a null
id with a null component). Vectors of different length never link. Repeated rows are rows of
their own and link with each other. Empty tables give no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import hash_sample
from .components import components

SAMPLE = 10_000  # vectors that the rotation is learned on
BITS = 64
ROUNDS = 30
BLOCK = 1_024  # classes of a bucket that stay together
MISS = 0.001  # wanted share of missed pairs right at the threshold
PAIRS = 10_000  # pairs made to estimate that share
TABLES = 64


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(sample: np.ndarray, bits: int = BITS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection; the signs of (unit(x) - mean) @ projection are the code."""
    x = unit(sample)
    mean = x.mean(0)
    x = x - mean
    d = min(x.shape[1], bits)
    _, _, axes = np.linalg.svd(x.T @ x)
    r = np.random.default_rng(seed)
    parts = []
    for at in range(0, bits, d):
        v = x @ axes[:d].T
        turn = np.linalg.qr(r.normal(size=(d, d)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        parts.append((axes[:d].T @ turn)[:, : bits - at])
    return mean, np.concatenate(parts, 1)


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits((unit(x) - mean) @ projection >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def masks(width: int, radius: int) -> np.ndarray:
    """All values of `width` bits with at most `radius` set, 0 first."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)], np.uint64)


def layout(tables: int, width: int) -> np.ndarray:
    """The bits of each table; every order of the bits after the first is drawn and serves BITS // width tables."""
    r = np.random.default_rng(5)
    each = BITS // width
    orders = [np.arange(BITS), *(r.permutation(BITS) for _ in range(-(-tables // each) - 1))]
    return np.concatenate([o[: each * width].reshape(each, width) for o in orders])[:tables]


def selected(bits: np.ndarray) -> np.ndarray:
    """A mask for each table."""
    return np.array([sum(1 << int(b) for b in own) for own in bits], np.uint64)


def enough(sample: np.ndarray, mean: np.ndarray, projection: np.ndarray, threshold: float) -> np.ndarray:
    """Bits of as few tables of 8 bits as miss at most `MISS` of pairs at the threshold; one table of no bits if `TABLES` miss more."""
    r = np.random.default_rng(3)
    u = unit(np.resize(sample, (PAIRS, sample.shape[1])))
    t = min(1.0, max(-1.0, threshold))
    apart = []
    for w in (r.normal(size=u.shape), u[r.permutation(len(u))]):  # apart by noise, and towards another vector
        w = w - (w * u).sum(1, keepdims=True) * u
        some = np.linalg.norm(w, axis=1) > 1e-6
        if some.any():
            apart.append(codes(u[some], mean, projection) ^ codes(t * u[some] + (1 - t * t) ** 0.5 * unit(w[some]), mean, projection))
    for tables in range(8, TABLES + 1, 8):
        bits = layout(tables, 8)
        if all((x[:, None] & selected(bits) != 0).all(1).mean() <= MISS for x in apart):
            return bits
    return np.zeros((1, 0), np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int | None = None, radius: int | None = None,
                    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    x = F.col("e")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("e"), F.col(f"`{label}`").alias("label"))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("ok", usable)
    classes = cut(rows.where("ok").groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = classes.count()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not n:
        return alone
    shapes = [r["d"] for r in classes.select(F.size("e").alias("d")).distinct().collect()]  # lengths of vectors: a handful
    given = tables is not None and radius is not None
    radius = radius if given else 0
    learned, probes = {}, {}
    for d in shapes:
        sample = hash_sample(classes.where(F.size("e") == d).select("e"), F.col("e"), SAMPLE).collect()
        x_ = np.array(sorted(r["e"] for r in sample), np.float64)
        learned[d] = learn(x_)
        bits = layout(tables, BITS // min(tables, 8)) if given else enough(x_, *learned[d], threshold)
        flips = masks(bits.shape[1], radius)
        probes[d] = selected(bits), np.array([[sum(1 << int(b) for k, b in enumerate(own) if int(f) >> k & 1) for f in flips] for own in bits], np.uint64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                vectors_ = batch.column(1).to_pylist()
                lengths = np.array([len(v) for v in vectors_])
                for d in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == d)
                    code = codes(np.array([vectors_[i] for i in own], np.float64), *learned[d])
                    parts, flips = probes[d]
                    value = ((code[:, None] & parts)[:, :, None] ^ flips).reshape(-1)
                    take, code = pa.array(np.repeat(own, flips.size)), np.repeat(code, flips.size)
                    t = np.tile(np.repeat(np.arange(len(parts), dtype=np.int32), flips.shape[1]), len(own))
                    home = np.tile((flips == 0).reshape(-1), len(own))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(2).take(take), batch.column(3).take(take), batch.column(1).take(take),
                         pa.array(code.view(np.int64)), pa.array(t), pa.array(value.view(np.int64)), pa.array(home)],
                        ["label", "rep", "copies", "e", "code", "t", "value", "home"])

    schema = (f"label {classes.schema['label'].dataType.simpleString()}, rep long, copies long, e {classes.schema['e'].dataType.simpleString()}, "
              "code long, t int, value long, home boolean")
    held = classes.select("label", "e", "rep", "copies").mapInArrow(emit, schema)
    key = ["label", "d", "t", "value"]
    held = cut(held.withColumn("d", F.size("e")))
    sizes = held.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).where("n > 1 AND homes > 0")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = (held.join(sizes.select(*key, blocks.alias("blocks")), key)
             .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))
    cells = (dealt.groupBy(*key, "i", "j")
             .agg(F.collect_list(F.struct("rep", "copies", "code", "home", "own", "e")).alias("m"))
             .where(F.size("m") > 1).select("t", "i", "j", "m"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            counts: list[np.ndarray] = []
            links: list[tuple[int, int]] = []
            for t, i, j, cell in zip(*(whole.column(k).to_pylist() for k in range(3)), whole.column(3), strict=True):
                rows_ = cell.values if hasattr(cell, "values") else pa.array(cell.as_py())
                rep, copies, code, home, own = (rows_.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                flat = rows_.field(5)
                x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rep), -1)
                parts = probes[x.shape[1]][0]
                x = unit(x)
                code = code.view(np.uint64)
                order = np.arange(len(rep))
                a_side, b_side = order, order[home]
                for at in range(0, len(a_side), 256):
                    a = a_side[at : at + 256]
                    good = (x[a] @ x[b_side].T >= threshold) & (rep[a][:, None] < rep[b_side][None])
                    if i != j:  # pairs inside a block are compared where it meets itself
                        good &= own[a][:, None] != own[b_side][None]
                    p, q = np.nonzero(good)
                    p, q = a[p], b_side[q]
                    if not len(p):
                        continue
                    apart = code[p] ^ code[q]
                    earlier = np.zeros(len(p), bool)  # found by a table before this one
                    for k in range(t):
                        earlier |= np.bitwise_count(apart & parts[k]) <= radius
                    p, q = p[~earlier], q[~earlier]
                    counts += [np.stack([rep[p], copies[q]]), np.stack([rep[q], copies[p]])]
                    links += [(int(rep[u]), int(rep[v])) for u, v in forest(len(rep), p, q)]
            if counts:
                found = np.concatenate(counts, 1)
                ids, place = np.unique(found[0], return_inverse=True)
                sums = np.zeros(len(ids), np.int64)
                np.add.at(sums, place, found[1])
                for at in range(0, len(ids), 50_000):
                    k = ids[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), -1)), pa.array(sums[at : at + 50_000])], ["a", "b", "n"])
                edges = np.array(links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.array(np.zeros(len(edges), np.int64))], ["a", "b", "n"])

    found = cut(cells.mapInArrow(compare, "a long, b long, n long"))
    linked = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = components(found.where("n = 0").select("a", "b")).withColumnRenamed("id", "rep")
    per_class = (classes.join(linked, "rep", "left").join(groups, "rep", "left")
                 .select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component", "rep").alias("component_id")))
    joined = (rows.where("ok").join(per_class, ["label", "e"])
              .select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")))
    rest = (rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                                        F.col("vec_id").isNotNull().alias("kept")))
    return joined.unionByName(rest)
