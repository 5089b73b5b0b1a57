"""Best-fit packing of tokenized documents with large-item matching.

Only lengths matter to the packing, so it is solved on their histogram, which has at most
`capacity` rows whatever the corpus: documents of more than a third of the capacity are matched
greedily, largest first with the largest partner that fits, two in a bin at most; the smaller
ones, largest first, go to the smallest gap of all open bins that they fit. Equal bins are kept
as one pattern with a count. Each document then finds its bin by its rank among the documents of
its length; ranks come from counts per hash bucket, so that a length shared by a third of all
rows is spread.

Null and empty texts are one piece that holds the end id only. Repeated rows and repeated
doc_ids are packed one by one; a null doc_id stays null. Empty tables give no rows; other
columns are not used.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import give_back

CAPACITY = 1024
END_ID = 2
CACHE_WORDS = 200_000  # entries of the word cache of a Python worker
ROWS_PER_BUCKET = 1_024

SPECIAL = "<|endoftext|>"
COMMON = re.compile(r"[\x00-ɏ]*")  # characters whose classes no Unicode version disputes
CUT = re.compile(r"(?<=\S) (?=\S)")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def exact_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def fast_tokenizer(path: str):
    """The same byte-level vocabulary from its ranks, which encodes one word some ten times faster."""
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def clean(word: str) -> bool:
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


class Encoder:
    """Token ids as little-endian 32-bit bytes.

    A text is cut before each single space that stands between two non-spaces; no token
    reaches over such a place, so the parts are encoded once and cached. Only words without
    white space at either end are cached: if all words of a text are found, all its cuts
    were at such places. Texts with the special token's string, and parts with characters
    beyond the Latin blocks, go to the tokenizer file itself.
    """

    def __init__(self, json_path: str, ranks_path: str):
        self.json_path, self.ranks_path = json_path, ranks_path
        self.cache: dict[str, bytes] = {}  # of words that follow a space, with that space

    def exact(self, text: str) -> bytes:
        return array("I", exact_tokenizer(self.json_path).encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, text: str) -> bytes:
        if COMMON.fullmatch(text):
            return array("I", fast_tokenizer(self.ranks_path).encode_ordinary(text)).tobytes()
        return self.exact(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return self.exact(text)
        words = text.split(" ")
        found = list(map(self.cache.get, words))
        if not clean(words[0]) or None in found and not all(clean(w) for w, x in zip(words, found, strict=True) if x is None):
            words = CUT.split(text)
            return self.part(words[0]) + b"".join(self.part(" " + w) for w in words[1:])
        found[0] = self.part(words[0])
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    found[k] = ids = self.part(" " + words[k])
                    if len(words[k]) <= 64:
                        if len(self.cache) >= CACHE_WORDS:
                            self.cache.clear()
                        self.cache[words[k]] = ids
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n tokens; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None,
           capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the token ids of each piece."""
    json_path, ranks_path = paths or default_paths()
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(json_path, ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[], [], [], [], []]
                tokens = []
                for key, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = code.encode(value) + end
                    for k, (s, n) in enumerate(bounds(len(raw) // 4, capacity)):
                        own = raw[4 * s : 4 * (s + n)]
                        for column, x in zip(out, (key, k, s, n, zlib.crc32(own)), strict=True):
                            column.append(x)
                        if ids:
                            tokens.append(array("I", own).tolist())
                arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    arrays, names = [*arrays, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)
        give_back()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    return rows.mapInArrow(run, PIECES + ", ids array<int>" * ids)


Pattern = tuple[int, ...]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns of a bin (its lengths) with the number of such bins: large documents are matched, the others fill the gaps."""
    large = {n: c for n, c in counts.items() if c and 3 * n > capacity}
    small = {n: c for n, c in counts.items() if c and 3 * n <= capacity}
    return best_fit(match_large(large, capacity), small, capacity)


def match_large(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Greedy matching: the largest document left takes the largest partner that fits, if any; two in a bin at most.

    Each step uses up a length, or all of it but one document, so the patterns are few, however large the counts.
    """
    left, order, found = dict(counts), sorted(counts), []
    while order:
        n = order[-1]
        k = bisect_right(order, capacity - n)
        # the last place is the document's own length, of which another one is needed
        if k == len(order) and left[n] == 1:
            k -= 1
        partner = order[k - 1] if k else None
        if partner is None:
            pattern, times = (n,), left[n]
        elif partner == n:
            pattern, times = (n, n), left[n] // 2
        else:
            pattern, times = (n, partner), min(left[n], left[partner])
        found.append((pattern, times))
        for x in pattern:
            left[x] -= times
            if not left[x]:
                del left[x], order[bisect_right(order, x) - 1]
    return found


def best_fit(bins: list[tuple[Pattern, int]], counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """`bins` with the documents of `counts` added: largest first, each to the smallest gap it fits, else to a new bin.

    Bins of the same gap are kept as one group of patterns. A length fills the bins of a gap as often as it fits,
    so it splits one pattern at most twice.
    """
    gaps: dict[int, list[tuple[Pattern, int]]] = {}
    for pattern, times in bins:
        gaps.setdefault(capacity - sum(pattern), []).append((pattern, times))
    order = sorted(gaps)

    def put(pattern: Pattern, times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((pattern, times))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            k = bisect_left(order, n)
            if k == len(order):
                each = capacity // n
                put((n,) * each, left // each) if left >= each else None
                if left % each:
                    put((n,) * (left % each), 1)
                break
            gap = order[k]
            pattern, times = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            each = gap // n
            full = min(times, left // each)
            rest = min(each, left - full * each) if full < times else 0
            if full:
                put(pattern + (n,) * each, full)
            if rest:
                put(pattern + (n,) * rest, 1)
            if times > full + bool(rest):
                put(pattern, times - full - bool(rest))
            left -= full * each + rest
    return [found for gap in order for found in gaps[gap]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first bin, offset): the documents of a length by rank, slot by slot."""
    used: dict[int, int] = {}
    out, bins = [], 0
    for pattern, times in patterns:
        at = 0
        for n in pattern:
            out.append((n, used.get(n, 0), times, bins, at))
            used[n] = used.get(n, 0) + times
            at += n
        bins += times
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`parts` (doc_id, piece, length, ...) with sequence_id and offset; lengths are from 1 to `capacity`."""
    spark = parts.sparkSession
    bucketed = cut(parts.withColumn("_hash", F.xxhash64("doc_id", "piece", "start", "ids_crc32")))
    counts = {r["length"]: r["n"] for r in bucketed.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = spark.createDataFrame(slots(solve(counts, capacity)) or [(0, 0, 0, 0, 0)],
                                   "length long, low long, ranks long, first long, offset long")
    buckets = max(1, -(-max(counts.values(), default=0) // ROWS_PER_BUCKET))
    bucketed = bucketed.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))

    from pyspark.sql import Window as W

    before = (bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
              .withColumn("_before", F.sum("n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("n")).drop("n"))
    within = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("_hash", "doc_id", "piece", "start")) - 1
    ranked = (bucketed.withColumn("_within", within).join(before, ["length", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_within")))
    # The slots of a length are ranges of ranks; the running array of a length is bounded by the patterns.
    ranges = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "ranks", "first", "offset"))).alias("_slots"))
    slot = F.element_at(F.filter("_slots", lambda s: (s["low"] <= F.col("_rank")) & (F.col("_rank") < s["low"] + s["ranks"])), 1)
    return (ranked.join(F.broadcast(ranges), "length").withColumn("_slot", slot)
            .withColumn("sequence_id", F.col("_slot.first") + F.col("_rank") - F.col("_slot.low"))
            .withColumn("offset", F.col("_slot.offset"))
            .select(*parts.columns, "sequence_id", "offset"))


def sequences(parts: DataFrame, packed: DataFrame) -> DataFrame:
    """The token ids of every sequence: `parts` with ids, joined to their places."""
    keys = ["doc_id", "piece", "start"]
    placed = parts.join(packed.select(*keys, "sequence_id", "offset"), keys)
    return (placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")))
