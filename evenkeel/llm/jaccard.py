"""Jaccard similarity join on word shingles with several global token orders.

A set of n tokens that is similar enough to another shares a token with it among its first
n - ceil(t*n) + 1 under any global order. Three orders are used, all with rare tokens first
and with different hashes behind. Candidates meet in the prefix buckets of one order and
must share a prefix token under each of the others before they are verified.

1. One pass over the texts gives each document's set size and signature; equal sets are one
   class, so copies never meet. The pass also keeps the most frequent tokens of each task
   (a bounded summary over all of its tokens).
2. A second pass deals the tokens, packed per batch of documents, to hash ranges that count
   document frequencies. Only tokens that other documents have are sent back. Tokens nobody
   shares come first in every order, so a document whose prefix they fill can have no
   partner and takes no further part; what is shared also is all that verification needs.
   Tokens known to be frequent are not dealt at all, so no range holds a hot one.
3. In each prefix bucket of the first order every document is verified against the bucket's
   leader (the one with the largest share of shared tokens), which ties large groups of near
   copies together with few pairs.
4. Documents that share a bucket and still are in different components meet in blocks of
   bounded size, where all of their pairs pass the filters of all orders and the exact test;
   no link between different texts is lost, and pairs that fail never leave the block.

Links: 100 * intersection >= percent * union. Null and empty texts and texts without words
have an empty set and link with nothing. Documents are known by doc_id: repeated rows are
returned each, rows that share a doc_id share their links; a null doc_id links with nothing
and has a null component. Empty tables give no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import best_rows, give_back
from .components import components
from .shingles import chunks, mix, shingle_sets

ORDERS = 3
TOKENS_PER_RANGE = 600_000  # expected tokens of a hash range, which is one group in a task
SUMMARY, FREQUENT = 4_096, 32_768  # entries of a task's summary and of the merged one
FREQUENT_FROM = 256  # documents from which a token may count as frequent
BLOCK = 256  # documents of a block in the last round
LOW = np.uint64((1 << 32) - 1)
EXACT = 128  # documents up to which a frequency is known exactly; from there on in eighths of its power of two

SETS = "b long, doc_id long, n long, s1 long, s2 long, token long, count long"
DEALT = "b long, p int, own boolean, docs binary, counts binary, tokens binary, weights binary"
SHARED = "doc_id long, n long, share double, first array<bigint>, places binary, tokens binary"


def prefix_length(n, percent: int):
    """Tokens of a set of n among which a partner's must be, under any order."""
    return n - (percent * n + 99) // 100 + 1


def level(df: np.ndarray) -> np.ndarray:
    """Frequencies in one byte; a larger one never has a smaller level."""
    df = np.maximum(df, 1)
    return np.where(df < EXACT, df, EXACT + np.minimum(127, np.floor(8 * np.log2(df / EXACT)))).astype(np.uint8)


def power(levels: np.ndarray) -> np.ndarray:
    """The power of two that a level belongs to."""
    w = levels.astype(np.int64)
    return np.where(w < EXACT, np.frexp(w.astype(np.float64))[1], 8 + (w - EXACT) // 8)


def token_width(ranges: int) -> int:
    """Bytes that the tokens of so many ranges need."""
    return -(-(32 + ranges.bit_length()) // 8)


def narrow(tokens: np.ndarray, width: int) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<i8")


def place_type(n: int):
    return np.uint16 if n < 1 << 16 else np.uint32


def prefixes(places: bytes, tokens: np.ndarray) -> list[np.ndarray]:
    """Prefix tokens under each order."""
    return list(tokens[np.frombuffer(places, place_type(len(tokens))).reshape(ORDERS, -1)])


def merge_summary(tokens: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` entries; what all entries lose together is the count of the first one left out."""
    ids, place = np.unique(tokens, return_inverse=True)
    sums = np.zeros(len(ids), np.int64)
    np.add.at(sums, place, counts)
    if len(ids) > most:
        sums = sums - np.partition(sums, len(sums) - most - 1)[len(sums) - most - 1]
        ids, sums = ids[sums > 0], sums[sums > 0]
    return ids, sums


def sets(docs: DataFrame, size: int) -> DataFrame:
    """A row (b, doc_id, n, s1, s2) per document, b being the number of its batch, and rows (token, count) of each task's summary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for whole in batches:
            for batch in chunks(whole, 1):
                g, n = shingle_sets(batch.column(1), size)
                full = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[full]
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(g):
                    s1[full] = np.add.reduceat(mix(g, 3), starts)
                    s2[full] = np.add.reduceat(mix(g, 4), starts)
                    fresh, count = np.unique(g, return_counts=True)
                    ids, sums = merge_summary(np.concatenate([ids, fresh]), np.concatenate([sums, count]), SUMMARY)
                nothing = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), number)), batch.column(0), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), nothing, nothing],
                    ["b", "doc_id", "n", "s1", "s2", "token", "count"])
                number += 1
        give_back()
        nothing = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, nothing, pa.array(ids.view(np.int64)), pa.array(sums)],
                                         ["b", "doc_id", "n", "s1", "s2", "token", "count"])
    return docs.mapInArrow(run, SETS)


def dealt(docs: DataFrame, size: int, ranges: int, frequent: np.ndarray, weights: np.ndarray) -> DataFrame:
    """Tokens of batches of documents by hash range; `own` rows carry the documents and their frequent tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in chunks(whole, 1):
                g, n = shingle_sets(batch.column(1), size)
                b, number = number, number + 1
                doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
                p = (g % np.uint64(ranges)).astype(np.int64)
                low = g // np.uint64(ranges) & LOW
                at = np.searchsorted(frequent, g)
                hot = (frequent[np.minimum(at, len(frequent) - 1)] == g) if len(frequent) else np.zeros(len(g), bool)
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                out = [(b, b % ranges, True, ids.tobytes() + n.astype(np.int64).tobytes(),
                        np.bincount(doc[hot], minlength=len(n)).astype(np.uint32).tobytes(),
                        (low[hot] * np.uint64(ranges) + p[hot].astype(np.uint64)).tobytes(), weights[at[hot]].tobytes() if hot.any() else b"")]
                rest = np.flatnonzero(~hot)
                rest = rest[np.argsort(p[rest], kind="stable")]
                places = p[rest]
                edges = np.flatnonzero(np.diff(places, prepend=-1))
                for s, e in zip(edges.tolist(), [*edges.tolist()[1:], len(rest)], strict=False):
                    d = doc[rest[s:e]]
                    change = np.flatnonzero(np.diff(d.astype(np.int64), prepend=-1))
                    out.append((b, int(places[s]), False, d[change].tobytes(), np.diff(np.append(change, e - s)).astype(np.uint32).tobytes(),
                                low[rest[s:e]].astype(np.uint32).tobytes(), b""))
                yield rows_of(out)
        give_back()
    return docs.mapInArrow(run, DEALT)


SHARED_KINDS = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
SHARED_NAMES = ["doc_id", "n", "share", "first", "places", "tokens"]


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                      ["b", "p", "own", "docs", "counts", "tokens", "weights"])


def count_range(table: pa.Table) -> pa.Table:
    """Tokens of one hash range that more than one document has, with the number of documents."""
    rows = table.to_pylist()
    tokens = [np.frombuffer(r["tokens"], np.uint32) for r in rows if not r["own"]]
    out = [tuple(r.values()) for r in rows if r["own"]]
    if tokens:
        _, place, df = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        df = level(df)[place]
        at = 0
        for r, own in zip((r for r in rows if not r["own"]), tokens, strict=True):
            weight = df[at : at + len(own)]
            at += len(own)
            keep = weight > 1
            if keep.any():
                docs = np.frombuffer(r["docs"], np.uint16)
                of = np.repeat(np.arange(len(docs)), np.frombuffer(r["counts"], np.uint32))
                count = np.bincount(of[keep], minlength=len(docs)).astype(np.uint32)
                out.append((r["b"], r["p"], False, docs[count > 0].tobytes(), count[count > 0].tobytes(), own[keep].tobytes(), weight[keep].tobytes()))
    give_back()
    return pa.Table.from_batches([rows_of(out)])


def shared_of(ranges: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Shared tokens of the documents of one batch that are not known as copies, and their prefixes under each order."""
        rows = table.to_pylist()
        mine = next((r for r in rows if r["own"]), None)
        copies = {int.from_bytes(r["docs"], "big", signed=True) for r in rows if r["p"] < 0}
        rows = [r for r in rows if r["p"] >= 0]
        if mine is None:  # the batches of the two passes differ; copies that stay do no harm
            return pa.Table.from_arrays([pa.array([], k) for k in SHARED_KINDS], SHARED_NAMES)
        ids, n = np.frombuffer(mine["docs"], np.int64).reshape(2, -1)
        of = [np.repeat(np.arange(len(ids)), np.frombuffer(mine["counts"], np.uint32))]
        tokens, weights = [np.frombuffer(mine["tokens"], np.uint64)], [np.frombuffer(mine["weights"], np.uint8)]
        for r in rows:
            if not r["own"]:
                of.append(np.repeat(np.frombuffer(r["docs"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.uint32)))
                tokens.append(np.frombuffer(r["tokens"], np.uint32).astype(np.uint64) * np.uint64(ranges) + np.uint64(r["p"]))
                weights.append(np.frombuffer(r["weights"], np.uint8))
        of, tokens, weights = np.concatenate(of), np.concatenate(tokens), np.concatenate(weights)
        order = np.argsort(of, kind="stable")
        tokens, weights = tokens[order], weights[order]
        held = np.bincount(of, minlength=len(ids))
        reach = np.minimum(prefix_length(n, percent) - (n - held), held)  # shared tokens inside the prefix
        out: list[list] = [[] for _ in SHARED_NAMES]
        ends = np.cumsum(held)
        for i in np.flatnonzero(reach > 0).tolist():
            if int(ids[i]) in copies:
                continue
            t, w = tokens[ends[i] - held[i] : ends[i]], weights[ends[i] - held[i] : ends[i]]
            up = np.argsort(t)
            t, w = t[up], w[up]
            step = power(w)  # orders after the first only know the size class of a frequency
            orders = [np.lexsort((t, w)), *[np.lexsort((mix(t, 10 + k), step)) for k in range(1, ORDERS)]]
            places = np.concatenate([o[: reach[i]] for o in orders]).astype(place_type(len(t)))
            for column, x in zip(out, (int(ids[i]), int(n[i]), float(held[i] / n[i]), t[orders[0][: reach[i]]].view(np.int64), places.tobytes(),
                                       narrow(t, token_width(ranges))), strict=True):
                column.append(x)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, SHARED_KINDS, strict=True)], SHARED_NAMES)
    return run


def verified(pairs: DataFrame, shared: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) among candidate pairs (x, y): shared prefixes under all orders, then the exact test."""
    one = shared.select("doc_id", F.struct("n", "places", "tokens").alias("held"))
    left = one.select(F.col("doc_id").alias("x"), F.col("held").alias("sx"))
    right = one.select(F.col("doc_id").alias("y"), F.col("held").alias("sy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, sx, sy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tx, ty = wide(sx["tokens"], width), wide(sy["tokens"], width)
                if not all(np.isin(px, py).any() for px, py in zip(prefixes(sx["places"], tx), prefixes(sy["places"], ty), strict=True)):
                    continue
                both = len(np.intersect1d(tx, ty, assume_unique=True))
                if 100 * both >= percent * (sx["n"] + sy["n"] - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return pairs.join(right, "y").join(left, "x").select("x", "y", "sx", "sy").mapInArrow(run, "a long, b long")


def jaccard_groups(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = cut(sets(texts, size))
    each = found.where("token IS NULL").select("b", "doc_id", "n", "s1", "s2")
    classes = (each.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2")
               .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    total = each.agg(F.sum("n")).first()[0] or 0
    summary = cut(found.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count"))
                  .where(F.col("count") >= FREQUENT_FROM).withColumn("size", F.log2("count")))
    top = best_rows(summary, "size", FREQUENT).select("token", "count").collect()  # FREQUENT rows at most
    frequent = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    weights = level(np.array([r["count"] for r in top], np.int64))[order]
    ranges = max(1, -(-total // TOKENS_PER_RANGE))

    counted = (dealt(texts.where("doc_id IS NOT NULL"), size, ranges, frequent[order], weights).repartition(ranges, "p")
               .groupBy("p").applyInArrow(count_range, DEALT))
    known = of_class(each, classes)
    if each.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").take(1):
        shared = cut(counted.groupBy("b").applyInArrow(shared_of(ranges, percent), SHARED))
        shared = cut(shared.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    else:  # copies are named to their batches, so that one document of each class goes on
        copies = known.where("doc_id <> rep").select(
            "b", F.lit(-1).alias("p"), F.lit(False).alias("own"), F.unhex(F.lpad(F.hex("doc_id"), 16, "0")).alias("docs"),
            *[F.lit(None).cast("binary").alias(c) for c in ("counts", "tokens", "weights")])
        shared = cut(counted.unionByName(copies).groupBy("b").applyInArrow(shared_of(ranges, percent), SHARED))
    links = linked(shared, percent, token_width(ranges))
    groups = components(links)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return (known.withColumn("own", own).join(groups.select(F.col("id").alias("own"), "component"), "own", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "own").alias("component_id")))


def of_class(each: DataFrame, classes: DataFrame, hot: int = 64) -> DataFrame:
    """`each` with the smallest doc_id of its set, where several rows have it.

    Sets that more than one in `hot` rows has are at most `hot` and are broadcast; the rest is joined by set.
    """
    repeated = cut(classes.where("copies > 1"))
    large = F.col("copies") * hot > each.count()
    common, rest = F.broadcast(repeated.where(large).drop("copies")), repeated.where(~large).drop("copies")
    by = ["n", "s1", "s2"]
    return each.join(common, by).unionByName(each.join(common, by, "left_anti").join(rest, by, "left"))


def keys(shared: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Prefix tokens under the first order, with the document's component so far."""
    rows = shared.select("doc_id", "n", "share", F.explode("first").alias("token"))
    if groups is None:
        return rows.withColumn("component", F.col("doc_id"))
    return rows.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def linked(shared: DataFrame, percent: int, width: int) -> DataFrame:
    """Links that connect all documents linked directly or by way of others."""
    rows = keys(shared, None)
    best = F.struct(F.col("share"), (-F.col("doc_id")).alias("d"), F.col("n"))
    leaders = (rows.groupBy("token").agg(F.max(best).alias("lead"), F.count("*").alias("docs")).where("docs > 1")
               .select("token", (-F.col("lead.d")).alias("x"), F.col("lead.n").alias("nx")))
    pairs = (rows.join(leaders, "token").where("doc_id <> x").where(near("n", "nx", percent))
             .select("x", F.col("doc_id").alias("y")).distinct())
    links = cut(verified(pairs, shared, percent, width))
    return links.unionByName(between_components(shared, components(links), percent, width))


def between_components(shared: DataFrame, groups: DataFrame, percent: int, width: int, block: int | None = None) -> DataFrame:
    """Links between documents of different components that share a prefix bucket.

    Documents are dealt into blocks of bounded size by the most frequent token they have in
    such a bucket, so that near copies sit together. Two blocks meet if a bucket has
    documents of both; only the links that connect something leave the meeting.
    """
    block = block or BLOCK
    rows = keys(shared, groups).select("doc_id", "token", "component")
    mixed = rows.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("docs")).where("c1 <> c2")
    rows = cut(rows.join(mixed.select("token", "docs"), "token"))
    anchors = rows.groupBy("doc_id", "component").agg(F.max(F.struct("docs", "token")).alias("anchor"))
    sizes = anchors.groupBy("anchor").agg(F.ceil(F.count("*") / block).alias("blocks"))
    place = F.xxhash64("anchor", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    placed = cut(anchors.join(sizes, "anchor").select("doc_id", "component", place.alias("block")))
    of_token = rows.select("doc_id", "token").join(placed.select("doc_id", "block"), "doc_id").select("token", "block").distinct()
    meetings = (of_token.join(of_token.select("token", F.col("block").alias("other")), "token").where("block <= other")
                .select("block", "other").distinct())
    sides = (meetings.select("block", "other", F.explode(F.array_distinct(F.array("block", "other"))).alias("own")))
    held = placed.withColumnRenamed("block", "own").join(shared.select("doc_id", "n", "places", "tokens"), "doc_id")
    cells = (sides.join(held, "own")
             .groupBy("block", "other").agg(F.collect_list(F.struct((F.col("own") == F.col("block")).alias("first"), "doc_id", "n", "component", "places", "tokens")).alias("m"))
             .select((F.col("block") == F.col("other")).alias("same"), "m"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for same, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = cell.values
                first, ids, n, component = (m.field(k).to_numpy(zero_copy_only=False) for k in ("first", "doc_id", "n", "component"))
                a = np.flatnonzero(first)
                b = a if same else np.flatnonzero(~first)
                good = component[a][:, None] != component[b][None]
                good &= 100 * np.minimum(n[a][:, None], n[b][None]) >= percent * np.maximum(n[a][:, None], n[b][None])
                if same:
                    good &= np.arange(len(a))[:, None] < np.arange(len(b))[None]
                if not good.any():
                    continue
                tokens = [wide(x, width) for x in m.field("tokens").to_pylist()]
                starts = [prefixes(x, t) for x, t in zip(m.field("places").to_pylist(), tokens, strict=True)]
                for k in range(ORDERS):
                    if good.any():
                        good &= common([starts[i][k] for i in a.tolist()], [starts[i][k] for i in b.tolist()]) > 0
                if good.any():
                    both = common([tokens[i] for i in a.tolist()], [tokens[i] for i in b.tolist()])
                    good &= 100 * both >= percent * (n[a][:, None] + n[b][None] - both)
                p, q = np.nonzero(good)
                found += forest(ids[a[p]].tolist(), ids[b[q]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
    return cells.mapInArrow(meet, "a long, b long")


def common(left: list[np.ndarray], right: list[np.ndarray], most: int = 4_000_000) -> np.ndarray:
    """How many tokens each of the left sets shares with each of the right ones."""
    def flat(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        tokens, of = np.concatenate(values), np.repeat(np.arange(len(values)), [len(v) for v in values])
        order = np.argsort(tokens, kind="stable")
        return tokens[order], of[order]
    (t, i), (u, j) = flat(left), flat(right)
    out = np.zeros(len(left) * len(right), np.int64)
    start, end = np.searchsorted(u, t, "left"), np.searchsorted(u, t, "right")
    hits = np.flatnonzero(end > start)
    sums = np.cumsum(end[hits] - start[hits])
    at = 0
    while at < len(hits):  # some millions of meetings at a time
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most)))
        own = hits[at:stop]
        count = end[own] - start[own]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[own], count)
        out += np.bincount(np.repeat(i[own], count) * len(right) + j[place], minlength=len(out))
        at = stop
    return out.reshape(len(left), len(right))


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Links without those between ends already connected."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = find(x), find(y)
        if p != q:
            top[p] = q
            out.append((x, y))
    return out


def near(a: str, b: str, percent: int):
    """Sizes of sets that can be similar enough."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")
