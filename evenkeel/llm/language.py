"""Language identification by compression.

Each language has a dictionary of raw text. A text is encoded with Zstandard once per language,
with that dictionary in front, and belongs to the language that makes it smallest. Texts are
reduced to lower-case letters and single blanks first, so that junk marks and capitals do not
decide, and are encoded whole, in pieces that all see the full dictionary.

Learning is from a bounded sample: of each of the `LANGUAGES` most frequent languages about
`SAMPLE` different texts, those with the smallest hashes, cut in pieces of which `DICTIONARY`
bytes are kept, again by hash. The sample depends on the texts alone, not on partitions. Counts
are over all rows. The dictionaries take LANGUAGES * DICTIONARY bytes at most (26 MB) and are
broadcast.

Null texts and texts without a letter are `und` with score 0, as are all texts if nothing was
learned. Equal sizes go to the language learned from more texts. The score is the share by which
the smallest size is below the next (1 if only one language is known); `sure` is false where it
is under `MARGIN`. Repeated rows get the same answer, an empty table gives no rows, other columns
stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, give_back
from .shingles import text_bytes

LANGUAGES, SAMPLE = 200, 256
DICTIONARY, CUT = 131_072, 512  # bytes of a dictionary, code points of a piece of it
PIECE = 4_096  # bytes that are encoded at a time
MARGIN = 0.01
UNKNOWN = "und"


@dataclass(frozen=True)
class Languages:
    """Names, the most learned first, and their dictionaries."""

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def letters(text: Column) -> Column:
    """Lower-case letters of a text with one blank for whatever else stands between."""
    return F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\p{L}]+", " "))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Dictionaries from the rows of `docs` with a language and a letter in the text."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), letters(F.col(f"`{text}`")).alias("body"))
    rows = rows.where("lang IS NOT NULL AND trim(body) <> ''").withColumn("h", F.xxhash64("body"))
    known = (rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts"))
             .orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    if not known:
        return Languages((), ())
    share = {r["lang"]: min(1.0, (2 * SAMPLE + 100) / max(1, r["texts"])) for r in known}
    below = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(2**63 - 1 if v == 1 else int(-(2**63) + v * 2**64)))])
    taken = rows.where(F.col("h") <= F.element_at(below, F.col("lang"))).select("lang", "body").distinct()
    pieces = taken.select("lang", F.explode(F.regexp_extract_all("body", F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))).alias("piece"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("piece", F.lit(7)), "piece")
    kept = pieces.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * DICTIONARY // CUT).collect()
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in kept:  # LANGUAGES * 2 * DICTIONARY / CUT rows at most
        parts.setdefault(r["lang"], []).append((r["place"], r["piece"]))
    names = tuple(r["lang"] for r in known if r["lang"] in parts)
    return Languages(names, tuple(" ".join(p for _, p in sorted(parts[n])).encode()[:DICTIONARY] for n in names))


def encoders(model: Languages) -> list:
    """For each language a function from bytes to the size of their encoding."""
    import zstandard

    settings = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=4, search_log=4, window_log=18, chain_log=17,
                                                   hash_log=16, write_content_size=0, write_checksum=0, write_dict_id=0)
    out = []
    for raw in model.dictionaries:
        own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=settings)
        out.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=own).compress)
    return out


def closest(pieces: list[bytes], compress: list) -> tuple[int, float]:
    """Place of the language with the smallest encoding and its lead over the next."""
    sizes = [sum(len(f(p)) for p in pieces) - len(pieces) * empty for f, empty in compress]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = [s for k, s in enumerate(sizes) if k != best]
    return best, (1 - sizes[best] / max(1, min(rest)) if rest else 1.0)


def identify(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and sure."""
    if not model.names:
        found = F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.arrow_udf("struct<k: int, score: double>")
        def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            compress = [(f, len(f(b""))) for f in encoders(shared.value)]
            for bodies in batches:
                raw, at = text_bytes(bodies)
                whole = raw.tobytes()
                k, score = np.full(len(bodies), -1, np.int32), np.zeros(len(bodies))
                for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if e - s > 1 or e > s and whole[s] != 0x20:
                        k[i], score[i] = closest([whole[a : min(a + PIECE, e)] for a in range(s, e, PIECE)], compress)
                yield pa.StructArray.from_arrays([pa.array(k), pa.array(score)], ["k", "score"])
            give_back()

        found = classify(letters(F.col(f"`{text}`")))
    f, pred, score, sure = (fresh(docs, x) for x in ("_found", "lang_pred", "score", "sure"))
    names = F.array(*[F.lit(n) for n in (*model.names, UNKNOWN)])
    place = F.when(F.col(f"{f}.k") < 0, len(model.names)).otherwise(F.col(f"{f}.k"))
    return docs.withColumn(f, found).select(*[F.col(f"`{c}`") for c in docs.columns], F.get(names, place).alias(pred), F.col(f"{f}.score").alias(score),
                                            ((F.col(f"{f}.k") >= 0) & (F.col(f"{f}.score") >= MARGIN)).alias(sure))


def held_out(doc_id: Column) -> Column:
    """True for a third of the ids, by checksum; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """The language of every document, learned from those that are not held out; a null id is not learned from."""
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang"))
    judged = identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "sure")
