"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into words at places no piece of the vocabulary reaches over: before a run of
space marks and, where the vocabulary allows it, between letters, digits and other characters.
Each distinct word is encoded once: its substrings up to the longest piece are exploded and
equi-joined to the piece table (as many rows as the vocabulary, so it is broadcast), the edges
are grouped by word, and a Spark higher-order `aggregate` folds them into the best segmentation.

Occurrences of words are not shuffled one by one: rows are read in batches of bounded size, in which a
text is the numbers of its words, packed. The distinct words of a batch are dealt by their hash into sorted, packed
buckets; buckets of the same number meet, where each distinct word is encoded once, and its ids come back to the
batch packed in the order of the bucket's words. Shuffled are the packed batches (once, read twice) and both kinds of buckets.

Two folds, by the kind of the model: for unigram models Viterbi over the end positions (best
score, ties to the longer last piece); for byte-pair models the best-scored adjacent pair is
merged again and again, leftmost first, because the path of the best score sum is not what
such models mean. Cuts are the bits of a number there. Merges only make pairs of later rank, but for the few
pieces that have a part of later rank, so one pass over the edges by rank serves; a word in which such
a piece does come up late is folded anew, with the best edge looked for after each merge.
Characters without a piece become byte pieces, or the unknown id.

Words beyond `LONG` characters, for which the fold would be quadratic, are merged with a heap
where the batch is read; the results are the same. Unigram models handle them by the fold.

Null texts have null ids, empty ones no ids. Every row is kept, repeated ones too. Empty tables give no rows; other columns pass
through, and the added names get a number if they are taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back

SPACE = "▁"
WORD = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
CLASSES = rf"{SPACE}*[\p{{L}}\p{{M}}]+|{SPACE}*\p{{Nd}}+|{SPACE}*[^{SPACE}\p{{L}}\p{{M}}\p{{Nd}}]+|{SPACE}+"
BATCH_ROWS, BATCH_CHARS = 8_192, 16 << 20  # a batch ends with the row that reaches either
PARTITION, GROUP = 32, 10  # batches are numbered by partition from the bit PARTITION; 2^GROUP partitions share their words
BUCKETS = 256
SLICE = 1 << 20  # words whose ids are put in order at a time, whole rows
ASCII = 128
LONG = 48
UNKNOWN_PENALTY = 10.0  # below the lowest score, as in the library


class Vocabulary:
    """Pieces, scores and settings of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, norm = model.trainer_spec.model_type, model.normalizer_spec
        if kind not in (1, 2):
            raise ValueError("only unigram and byte-pair models are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that keep characters and spaces as they are are supported")
        self.bpe, self.prefix = kind == 2, norm.add_dummy_prefix
        self.pieces = [(p.piece, i, float(p.score)) for i, p in enumerate(model.pieces) if p.type == 1]
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in self.pieces):
            raise ValueError("pieces reach over spaces")
        self.bytes = [i for i, p in enumerate(model.pieces) if p.type == 6]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.fallback = model.trainer_spec.byte_fallback and len(self.bytes) == 256
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.lowest = min(s for _, _, s in self.pieces)
        self.size = len(model.pieces)
        self.word = CLASSES if all(regex.fullmatch(CLASSES, p) for p, _, _ in self.pieces) else WORD
        # pieces by falling score; equal scores share a rank
        ranks = {s: k for k, s in enumerate(sorted({s for _, _, s in self.pieces}, reverse=True))}
        rank = {p: ranks[s] for p, _, s in self.pieces}
        self.ranked = [(p, (rank[p] << 33) + (i << 1) + late(p, rank)) for p, i, _ in self.pieces]
        # what an id stands for: bytes in hex; control pieces stand for nothing
        self.surface = [(i, p.piece[3:5] if p.type == 6 else " ⁇ ".encode().hex() if p.type == 2 else
                         "" if p.type == 3 else p.piece.replace(SPACE, " ").encode().hex()) for i, p in enumerate(model.pieces)]


def late(piece: str, rank: dict[str, int]) -> bool:
    """Whether a part of the piece can be merged after the piece's own turn."""
    parts = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
    return any(all(len(x) == 1 or x in rank for x in ab) and any(len(x) > 1 and rank[x] >= rank[piece] for x in ab) for ab in parts)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def edge(edges: Column, start: Column, length: Column) -> Column:
    return F.try_element_at(edges, start * 64 + length)


def bound(value: Column, use) -> Column:
    """`use` of a value that is computed once, not at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edge_start(e: Column) -> Column:
    return F.shiftright(e, 27).bitwiseAND(63)


def edge_length(e: Column) -> Column:
    return F.shiftright(e, 21).bitwiseAND(63)


def marked(e: Column) -> Column:
    """An edge with the bits of its ends, of them and the boundaries between, and of all but those between."""
    start, length = edge_start(e), edge_length(e)
    return bound(F.call_function("shiftleft", bit(length - 1) - 1, (start + 1).cast("int")), lambda inner: bound(
        bit(start).bitwiseOR(bit(start + length)), lambda ends: F.struct(
            e.alias("edge"), ends.alias("ends"), ends.bitwiseOR(inner).alias("span"), F.bitwise_not(inner).alias("rest"))))


def ready(cuts: Column, e: Column) -> Column:
    """Whether the ends of an edge are left and just one boundary is between them."""
    return (F.bit_count(cuts.bitwiseAND(e["span"])) == 3) & (cuts.bitwiseAND(e["ends"]) == e["ends"])


def merge_fold(n: Column, edges: Column) -> Column:
    """Boundaries left after merging the best adjacent pair until none is a piece; bit k of a number says that a boundary is left at k.

    One pass over the edges by rank, which gives -1 if a merge makes an edge of an earlier turn ready; then `search_fold` is taken.
    """
    def sweep(es: Column, lates: Column) -> Column:
        def step(cuts: Column, e: Column) -> Column:
            merged = cuts.bitwiseAND(e["rest"])
            missed = F.exists(lates, lambda q: (q["edge"] < e["edge"]) & ready(merged, q))
            return F.when((cuts == -1) | ~ready(cuts, e), cuts).when(missed, F.lit(-1).cast("long")).otherwise(merged)
        return F.aggregate(es, bit(n + 1) - 1, step)
    cuts = bound(F.transform(F.sort_array(edges), marked), lambda es: bound(
        bound(F.filter(es, lambda e: e["edge"].bitwiseAND(1) == 1), lambda lates: sweep(es, lates)), lambda c: F.when(c == -1, search_fold(n, es)).otherwise(c)))
    return bound(cuts, lambda c: F.filter(F.sequence(F.lit(0), n), lambda k: c.bitwiseAND(bit(k)) != 0))


def search_fold(n: Column, edges: Column) -> Column:
    """The same boundaries, with the best edge looked for after each merge."""
    def step(cuts: Column, _: Column) -> Column:
        best = F.array_min(F.filter(edges, lambda e: ready(cuts, e)))
        return bound(best, lambda e: F.when(e.isNull(), cuts).otherwise(cuts.bitwiseAND(e["rest"])))
    return F.aggregate(F.sequence(F.lit(1), n), bit(n + 1) - 1, step)


def bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def viterbi_fold(n: Column, edges: Column, longest: int, unknown: float) -> Column:
    """Boundaries of the path with the best score sum; ties go to the longer last piece."""
    best_type = "array<struct<score:double,length:int>>"
    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("length"))).cast(best_type)

    def step(acc: Column, end: Column) -> Column:
        def reach(length: Column) -> Column:
            score = F.coalesce(edge(edges, end - length, length)["score"], F.when(length == 1, F.lit(unknown)))
            return F.struct((F.get(acc, end - length)["score"] + score).alias("score"), length.alias("length"))
        ways = F.transform(F.sequence(F.lit(1), F.least(end, F.lit(longest))), reach)
        return F.concat(acc, F.array(F.array_max(F.filter(ways, lambda w: w["score"].isNotNull()))).cast(best_type))

    def trace(best: Column) -> Column:
        def back(acc: Column, _: Column) -> Column:
            first = F.get(acc, F.lit(0))
            return F.when(first > 0, F.concat(F.array(first - F.get(best, first)["length"]), acc)).otherwise(acc)
        return F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)
    return bound(F.aggregate(F.sequence(F.lit(1), n), zero, step), trace)


def segment_words(words: DataFrame, vocab: Vocabulary, keys: Sequence[str] = ()) -> DataFrame:
    """`keys`, word, ids of distinct words (`word`), none of them empty or null; for byte-pair models none beyond `LONG` characters."""
    return merged_words(words, vocab, list(keys)) if vocab.bpe else viterbi_words(words, vocab, list(keys))


def substrings(words: DataFrame, longest: int, keys: Sequence[str]) -> DataFrame:
    starts = words.withColumn("n", F.char_length("word"))
    starts = starts.select(*keys, "word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    strings = starts.select(*keys, "word", "n", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("start")))).alias("length"))
    return strings.withColumn("piece", F.substr("word", F.col("start") + 1, F.col("length")))


def other_ids(text: Column, vocab: Vocabulary) -> Column:
    """Ids of a character that is no piece."""
    if not vocab.fallback:
        return F.array(F.lit(vocab.unknown))
    code = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int")), lambda k: F.get(
        F.array(*map(F.lit, vocab.bytes)), F.conv(F.substr(code, k * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def merged_words(words: DataFrame, vocab: Vocabulary, keys: list[str]) -> DataFrame:
    """Words of at most `LONG` characters by merges. An edge is a number: rank, start, length and id of its piece, and whether it can be late.

    The ids of ASCII characters and of the space mark are in the plan; edges of one character are joined for others only.
    """
    spark = words.sparkSession
    if vocab.size >= 1 << 20:
        raise ValueError("vocabularies of 2^20 pieces or more are not supported")
    pieces = spark.createDataFrame(vocab.ranked, "piece string, code long").coalesce(1)
    one = {p: i for p, i, _ in vocab.pieces if len(p) == 1}
    plain = F.array(*[F.lit(one.get(chr(k))).cast("int") for k in range(ASCII)])
    strings = substrings(words, vocab.longest, keys)
    # the first character's row is always kept, so that no word is lost
    known = (F.ascii("piece") < ASCII) | (F.col("piece") == SPACE)
    strings = strings.where((F.col("length") > 1) | (F.col("start") == 0) | ~known)
    at = F.col("start").cast("long") * (1 << 27) + F.col("length") * (1 << 21)
    edges = (strings.join(F.broadcast(pieces), "piece", "left").where(F.col("code").isNotNull() | (F.col("start") == 0))
             .select(*keys, "word", (F.col("code") + at).alias("edge")).groupBy(*keys, "word").agg(F.collect_list("edge").alias("edges")))
    pairs = F.filter("edges", lambda e: e.bitwiseAND(62 << 21) != 0)
    n = F.char_length("word")

    def ids(first: Column, stop: Column) -> Column:
        text = F.substr("word", first + 1, stop - first)
        place = (first * 64 + stop - first).cast("long") * (1 << 21)
        found = F.get(F.filter("edges", lambda e: e.bitwiseAND(4095 << 21) == place), F.lit(0))
        joined = F.shiftright(found, 1).bitwiseAND((1 << 20) - 1).cast("int")
        code = F.when(stop - first > 1, joined).when(text == SPACE, F.lit(one.get(SPACE)).cast("int")).when(
            F.ascii(text) < ASCII, F.get(plain, F.ascii(text))).otherwise(joined)
        return bound(code, lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(other_ids(text, vocab)))

    def all_ids(cuts: Column) -> Column:
        return F.flatten(F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), ids))
    return edges.select(*keys, "word", bound(merge_fold(n, pairs), all_ids).alias("ids"))


def viterbi_words(words: DataFrame, vocab: Vocabulary, keys: list[str]) -> DataFrame:
    pieces = words.sparkSession.createDataFrame(vocab.pieces, "piece string, id int, score double").coalesce(1)
    edges = (substrings(words, vocab.longest, keys).join(F.broadcast(pieces), "piece")
             .groupBy(*keys, "word").agg(F.map_from_entries(F.collect_list(F.struct((F.col("start") * 64 + F.col("length")).alias("at"),
                                                                            F.struct("score", "id").alias("piece")))).alias("edges")))
    # words of unknown characters alone have no edge
    edges = words.join(edges, [*keys, "word"], "left").withColumn(
        "edges", F.coalesce("edges", F.create_map().cast("map<int,struct<score:double,id:int>>")))
    table = F.col("edges")
    fold = viterbi_fold(F.char_length("word"), table, vocab.longest, vocab.lowest - UNKNOWN_PENALTY)

    def ids(start: Column, end: Column) -> Column:
        known = edge(table, start, end - start)["id"]
        return F.when(known.isNotNull(), F.array(known)).otherwise(other_ids(F.substr("word", start + 1, end - start), vocab))

    def all_ids(cuts: Column) -> Column:
        return F.flatten(F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), ids))
    return edges.select(*keys, "word", bound(fold, all_ids).alias("ids"))


def merge_with_heap(word: str, scores: dict[str, tuple[float, int]], vocab: Vocabulary) -> list[int]:
    """The same merges in n log n steps."""
    from heapq import heapify, heappop, heappush

    parts: list[str | None] = list(word)
    after = [*range(1, len(parts)), -1]
    before = [-1, *range(len(parts) - 1)]
    heap = [(-scores[a + b][0], i, a + b) for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if a + b in scores]
    heapify(heap)
    while heap:
        _, i, piece = heappop(heap)
        j = after[i] if parts[i] is not None else -1
        if j < 0 or parts[i] + parts[j] != piece:
            continue
        parts[i], parts[j] = piece, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and parts[a] + parts[b] in scores:
                heappush(heap, (-scores[parts[a] + parts[b]][0], a, parts[a] + parts[b]))
    out: list[int] = []
    for p in parts:
        if p is not None:
            out += [scores[p][1]] if p in scores else [vocab.bytes[x] for x in p.encode()] if vocab.fallback else [vocab.unknown]
    return out


class Numbers(dict):
    """Numbers keys by their first appearance."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def chunks(texts: pa.Array, prefix: bool) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts, marked, cut before their runs of space marks: the numbers of the chunks, the distinct chunks, and how many each text has.

    One space mark at a chunk's start is left out; other chunks get one.
    """
    lists, odd = pc.split_pattern(texts, " "), pc.is_valid(texts)
    if prefix:
        odd = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")), pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)))
        odd = pc.or_(odd, pc.equal(texts, "")).fill_null(False)
    rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(rows):
        cut = []
        for k in rows:
            value = texts[k].as_py()
            marked = (SPACE if prefix and value else "") + value.replace(" ", SPACE)
            cut.append([c[1:] if len(c) > 1 and c[0] == SPACE != c[1] else SPACE + c for c in re.findall(WORD, marked)])
        take = np.arange(len(texts))
        take[rows] = len(texts) + np.arange(len(rows))
        lists = pa.concat_arrays([lists, pa.array(cut, pa.list_(pa.string()))]).take(pa.array(take))
    numbers = lists.flatten().dictionary_encode()
    return numbers.indices.to_numpy(zero_copy_only=False), numbers.dictionary.to_numpy(zero_copy_only=False).tolist(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def chunk_words(numbers: np.ndarray, distinct: list[str], lengths: np.ndarray, find) -> tuple[Numbers, np.ndarray, np.ndarray]:
    """Numbers of the words of chunks, the numbers of all words of the texts, and how many each text has."""
    words = Numbers()
    # of chunks in one string each starts with a word that has a space mark
    mixed = iter([])
    if rest := [c for c in distinct if c[0] != SPACE and not c.isalpha()]:
        mixed = iter(find(SPACE + SPACE.join(rest)))
    ahead = next(mixed, None)
    of: list[list[int]] = []
    for c in distinct:
        if c[0] == SPACE:
            of.append([words[w] for w in find(c[1:])])
        elif c.isalpha():
            of.append([words[SPACE + c]])
        else:
            own = [words[ahead]]
            while (ahead := next(mixed, None)) is not None and ahead[0] != SPACE:
                own.append(words[ahead])
            of.append(own)
    sizes = np.fromiter(map(len, of), np.int64, len(of))
    values = np.fromiter(chain.from_iterable(of), np.int32)
    n = sizes[numbers]
    ends = np.cumsum(n)
    codes = values[np.repeat((np.cumsum(sizes) - sizes)[numbers] - ends + n, n) + np.arange(n.sum())]
    return words, codes, np.diff(np.append(0, ends)[np.append(0, np.cumsum(lengths))])


def batches(docs: DataFrame, text: str, keep: Sequence[str], vocab: Vocabulary) -> DataFrame:
    """A row per batch: batch, its distinct words in buckets, sorted and joined by spaces (which no word has), the ids of those too long for the fold, its rows
    with their counts of words (null: no text), and the numbers of all their words, packed: see `pack`."""
    row = T.StructType([*kept_fields(docs, keep), T.StructField("n", T.IntegerType())])
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("words", T.ArrayType(T.StructType(
        [T.StructField("bucket", T.IntegerType()), T.StructField("words", T.StringType())]))),
        T.StructField("done", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("rows", T.ArrayType(row)),
        T.StructField("codes", T.BinaryType()), T.StructField("places", T.BinaryType())])
    word, prefix, longest = vocab.word, vocab.prefix, LONG if vocab.bpe else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(word).findall
        scores = {p: (s, i) for p, i, s in vocab.pieces}
        number = TaskContext.get().partitionId() << PARTITION
        for part in parts:
            texts, start, chars = part.column(0), 0, 0
            sizes = pc.utf8_length(texts).fill_null(0).to_pylist()
            for k, size in enumerate(sizes):
                chars += size
                if chars >= BATCH_CHARS or k + 1 - start == BATCH_ROWS or k + 1 == part.num_rows:
                    some = part.slice(start, k + 1 - start)
                    words, flat, counts = chunk_words(*chunks(some.column(0), prefix), find)
                    buckets, long, codes, places = pack(words, flat, longest)
                    missing = some.column(0).is_null().to_numpy(zero_copy_only=False)
                    rows = pa.StructArray.from_arrays([*some.columns[1:], pa.array(counts, pa.int32(), mask=missing)], [f.name for f in row.fields])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number], pa.int64()),
                        pa.array([buckets], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.string())]))),
                        pa.array([[merge_with_heap(w, scores, vocab) for w in long]], pa.list_(pa.list_(pa.int32()))),
                        pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                        pa.array([codes], pa.binary()), pa.array([places], pa.binary())], schema.names)
                    number, start, chars = number + 1, k + 1, 0
        give_back()

    columns = [F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]]
    return docs.select(*columns).mapInArrow(run, schema)


def kept_fields(docs: DataFrame, keep: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(keep)]


def pack(words: Numbers, flat: np.ndarray, longest: int | None) -> tuple[list[dict], list[str], bytes, bytes]:
    """Buckets of the words, the words too long for the fold, the numbers of the words by falling frequency, and for each of these
    numbers the word's place, in the order of the buckets, the long words last."""
    dealt: list[list[str]] = [[] for _ in range(BUCKETS + 1)]
    for w in words:
        dealt[BUCKETS if longest is not None and len(w) > longest else crc32(w.encode()) % BUCKETS].append(w)
    for x in dealt:
        x.sort()
    order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    codes, places = np.empty(len(words), "<u4"), np.empty(len(words), "<u4")
    codes[order] = np.arange(len(words), dtype="<u4")
    places[np.fromiter(map(words.__getitem__, chain.from_iterable(dealt)), np.int64, len(words))] = np.arange(len(words), dtype="<u4")
    buckets = [{"bucket": k, "words": " ".join(x)} for k, x in enumerate(dealt[:-1]) if x]
    return buckets, dealt[-1], pack_numbers(codes[flat]), pack_numbers(places[order])


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Byte place by byte place under Zstandard."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_ids(ids: pa.Array) -> bytes:
    lengths = ids.value_lengths().to_numpy(zero_copy_only=False)
    return pack_numbers(np.concatenate([[len(lengths)], lengths, ids.flatten().to_numpy(zero_copy_only=False)]))


def unpack_ids(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the ids of all."""
    numbers = unpack_numbers(packed).astype(np.int64)
    n = int(numbers[0])
    return numbers[1 : n + 1], numbers[n + 1 :].astype(np.int32)


def bucket_rows(held: DataFrame) -> DataFrame:
    """A row per batch and bucket. All columns of the batches are read, so that they are shuffled once for this and for `in_order`."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                words, batch = part.column("words")[k].values, part.column("batch")[k].as_py()
                n = len(words)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch >> (PARTITION + GROUP)] * n, pa.int64()), words.field("bucket"), pa.array([batch] * n, pa.int64()), words.field("words")],
                    ["group", "bucket", "batch", "words"])
    return held.mapInArrow(run, "group long, bucket int, batch long, words string")


def looked_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of a bucket the ids of its words, packed, and a checksum of the words they are of."""
    for part in parts:
        for k in range(part.num_rows):
            known, members = part.column("known")[k].values, part.column("members")[k].values
            lists = pc.split_pattern(members.field("words"), " ")
            at = pc.index_in(lists.flatten(), value_set=known.field("word"))
            if at.null_count:
                raise ValueError("a word of the batch was not encoded")
            out, start = [], 0
            for words, n in zip(members.field("words"), lists.value_lengths().to_pylist(), strict=True):
                out.append((crc32(words.as_buffer()), pack_ids(known.field("ids").take(at.slice(start, n)))))
                start += n
            n = len(out)
            yield pa.RecordBatch.from_arrays([
                members.field("batch"), pa.array([part.column("bucket")[k].as_py()] * n, pa.int32()), pa.array([x for x, _ in out], pa.int64()),
                pa.array([x for _, x in out], pa.binary())], ["batch", "bucket", "crc", "ids"])
    give_back()


def in_order(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows of a batch and the ids of each in their order, from the ids of its distinct words."""
    rows = batch.column("rows")[k].values
    found = {x["bucket"]: x for x in batch.column("found")[k].as_py() or []}
    parts = []
    for x in batch.column("words")[k].as_py():
        told = found.get(x["bucket"])
        if told is None or told["crc"] != crc32(x["words"].encode()):
            raise ValueError("a batch has other words than when its words were encoded: its rows were read again in another order")
        parts.append(unpack_ids(told["ids"]))
    done = batch.column("done")[k].values
    parts.append((done.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), done.flatten().to_numpy(zero_copy_only=False)))
    lengths, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts = np.cumsum(lengths) - lengths
    places = unpack_numbers(batch.column("places")[k].as_py())
    codes = unpack_numbers(batch.column("codes")[k].as_py())
    words = np.append(0, np.cumsum(rows.field("n").fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
    first = 0
    while first < len(rows):
        stop = max(first + 1, int(np.searchsorted(words, words[first] + SLICE, "right")) - 1)
        some = rows.slice(first, stop - first)
        at = places[codes[words[first] : words[stop]]]
        sizes = lengths[at]
        ends = np.cumsum(sizes)
        flat = values[np.repeat(starts[at] - ends + sizes, sizes) + np.arange(sizes.sum())]
        offsets = np.append(0, ends)[words[first : stop + 1] - words[first]]
        nulls = np.append(pc.is_null(some.field("n")).to_numpy(zero_copy_only=False), False)
        yield some, pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=nulls), pa.array(flat, pa.int32()))
        first = stop


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """`docs`, or the columns of it in `keep`, and the token ids of `text`."""
    vocab = vocabulary(path or default_path())
    keep, out = docs.columns if keep is None else list(keep), fresh(docs, ids)
    # counts are given, as packed rows are more work than their size says
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = batches(docs, text, keep, vocab).repartition(n, "batch")
    # each word is encoded once for so many partitions, so that no bucket gathers more than their batches
    keys = ["group", "bucket"]
    dealt = bucket_rows(held).dropna().repartition(n, *keys)
    members = dealt.groupBy(*keys).agg(F.collect_list(F.struct("batch", "words")).alias("members"))
    # all columns are read here too, so that the buckets are shuffled once
    words = dealt.select(*keys, "batch", F.explode(F.split("words", " ")).alias("word")).groupBy(*keys, "word").agg(F.max("batch").alias("b")).where("b is not null")
    known = segment_words(words.select(*keys, "word"), vocab, keys).groupBy(*keys).agg(F.collect_list(F.struct("word", "ids")).alias("known"))
    found = members.join(known, keys).mapInArrow(looked_up, "batch long, bucket int, crc long, ids binary")
    found = found.groupBy("batch").agg(F.collect_list(F.struct("bucket", "crc", "ids")).alias("found"))
    joined = held.join(found, "batch", "left")
    schema = T.StructType([*kept_fields(docs, keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                for rows, coded in in_order(part, k):
                    yield pa.RecordBatch.from_arrays([*rows.flatten()[:-1], coded], schema.names)
        give_back()

    rows = joined.mapInArrow(run, schema)
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], F.col("ids").alias(out))


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` and the text that the token ids stand for; ids outside the vocabulary raise an error, null ids give null.

    The surfaces are one array of as many entries as the vocabulary, so nothing is shuffled.
    """
    vocab = vocabulary(path or default_path())
    out = fresh(docs, text)
    # the plan holds one string, which the optimizer turns into an array once
    surfaces = F.split(F.lit(",".join(h for _, h in vocab.surface)), ",", -1)
    known = F.transform(F.col(f"`{ids}`"), lambda i: F.coalesce(F.get(surfaces, i), F.raise_error(
        F.concat(F.lit("no piece has id "), F.coalesce(i.cast("string"), F.lit("null"))))))
    whole = F.decode(F.unhex(F.array_join(known, "")), "UTF-8")
    return docs.withColumn(out, bound(whole, lambda w: F.when(w.startswith(" "), F.substr(w, F.lit(2))).otherwise(w)) if vocab.prefix else whole)
