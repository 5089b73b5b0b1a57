"""What each filter of a chain removes in every order, and its share over all orders.

A removal game has the filters as players; a coalition's worth is the number of documents that
fail one of its filters. Documents are counted once per part and set of failed filters, so a part
is 32 counts for five filters. From these follow the worths of all coalitions, the Hart-Mas-Colell
potential by recursion over coalitions of growing size,

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,    P(empty) = 0,

the Shapley value of filter i as P(all) - P(all without i), and every step of every order as a
difference of two worths. |S|! * P(S) is kept instead of P(S), so all numbers are whole.

Repetition (a text that a smaller doc_id has) is not joined row by row: all rows fail it but those
that hold the smallest id of their text, and only these are looked up. Rows with a null id neither
fail it nor make others fail; rows that repeat an id and its text do not fail by each other. Null
texts are empty, a null source is the empty string, a document without labels is neither good nor
toxic, one with several labels is what any of them says. An empty table gives no rows; other
columns are not used.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

FILTERS = "ABCDE"
LAST = FILTERS.index("E")  # the filter on repetition
WORD = r"[^\x20\x09-\x0D]+"


def failed(text: Column) -> Column:
    """Bits of the filters that a text fails by itself."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, marks = F.size(words), F.regexp_count(text, F.lit("[A-Z]"))
    rules = (n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * marks > 5 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(rule, 1 << k).otherwise(0) for k, rule in enumerate(rules)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (of failed filters), good, toxic and n, the number of such documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), failed(text).alias("mask"))
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = (rows.join(said, "doc_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}))
    rows = cut(rows)  # some sixty bytes a document: read three times below
    key = ["part", "mask", "good", "toxic"]
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = rows.join(firsts, ["digest", "doc_id"], "left_semi").unionByName(rows.where("doc_id IS NULL"))
    signed = rows.select(*key, F.lit(1).alias("all"), F.lit(0).alias("first")).unionByName(first.select(*key, F.lit(0).alias("all"), F.lit(1).alias("first")))
    counts = signed.groupBy(*key).agg(F.sum("first").alias("first"), (F.sum("all") - F.sum("first")).alias("again"))
    repeated = F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + (1 << LAST)).alias("mask"), F.col("again").alias("n")))
    return counts.select("part", "good", "toxic", F.explode(repeated).alias("c")).select("part", "c.mask", "good", "toxic", "c.n").where("n > 0")


def potentials(worth: Column, filters: int) -> Column:
    """|S|! * P(S) for every coalition S, from the worths; each needs only coalitions with smaller numbers."""
    def grown(known: Column, s: Column) -> Column:
        size = F.bit_count(s)
        ways = F.get(F.array(*[F.lit(factorial(max(0, k - 1))).cast("long") for k in range(filters + 1)]), size)
        smaller = sum((F.when(s.bitwiseAND(F.lit(1 << k)) > 0, F.get(known, s - (1 << k))).otherwise(F.lit(0).cast("long")) for k in range(filters)), F.lit(0).cast("long"))
        return F.concat(known, F.array(ways * F.get(worth, s) + smaller))
    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), grown)


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order and step; `counts` has part, mask, good, toxic and n."""
    size, everyone = len(filters), (1 << len(filters)) - 1
    held = {"n": F.col("n"), "good": F.when(F.col("good"), F.col("n")), "toxic": F.when(F.col("toxic"), F.col("n"))}

    def worth(game: str, coalition: int) -> Column:
        hit = F.col("mask").bitwiseAND(F.lit(coalition)) > 0
        return F.coalesce(F.sum(F.when(hit, held[game])), F.lit(0)).cast("long").alias(f"{game}{coalition}")

    games = counts.groupBy("part").agg(F.sum("n").alias("total"), *[worth(c, s) for c in held for s in range(everyone + 1)])
    games = games.select("part", "total", *[F.array(*[f"{c}{s}" for s in range(everyone + 1)]).alias(c) for c in held])
    games = games.withColumn("potential", potentials(F.col("n"), size))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(filters))), ",")
    steps = games.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.substring("filter_order", place, F.lit(1))) - 1)

    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda a, k: a + F.when(k > 0, bit(k)).otherwise(0))
    steps = steps.withColumn("own", bit(F.col("step"))).withColumn("before", before).withColumn("after", F.col("before") + F.col("own"))

    def lost(game: str) -> Column:
        return F.get(game, F.col("after")) - F.get(game, F.col("before"))

    rest = F.lit(everyone) - F.col("own")
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.get("n", F.col("after"))).alias("kept"), lost("n").alias("removed"),
        (F.get("n", F.col("own")) - lost("n")).alias("redundant"), (F.get("n", F.lit(everyone)) - F.get("n", rest)).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(everyone)) - size * F.get("potential", rest)).alias("shapley"))
