"""Chat formatting with Spark expressions only.

The template: `<s>`, then one block per run of turns of the same role. A user block is
`[INST]...[/INST]`, an assistant block `[BOT]...</s>`, any other role
`[ROLE]name[TEXT]...[/ROLE]`; the texts of adjacent turns of the same role share a block
and are parted by `[NEXT]`. A control string inside a text gets one tilde behind its first
character (`<~s>`; one that has tildes already gets one more), so that `parse` can undo it.

Turns are pre-aggregated by conversation and by 256 turn numbers, so that a very long
conversation reaches its own task as a few merged pieces.

Null texts count as empty, null roles are kept as such (`[NONE]`), null turns come first,
turns with equal numbers are ordered by role and text and all kept (repeated rows too), a
null conversation id is a conversation of its own. Other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, NEXT = "<s>", "[NEXT]"
NAMES = "s|INST|BOT|ROLE|TEXT|NEXT|NONE"
CONTROL = rf"(<|\[)(~*)(/?(?:{NAMES}))(>|\])"
ESCAPED = rf"(<|\[)(~*)~(/?(?:{NAMES}))(>|\])"
TURNS_PER_CHUNK = 256

BLOCKS = "array<struct<role:string,texts:array<string>>>"
PIECES = "array<struct<text:string,loss:boolean>>"
MASK = "array<struct<start:bigint,length:bigint,first_byte:bigint,bytes:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1$2~$3$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3$4")


def opening(role: Column) -> Column:
    return (F.when(role == "user", "[INST]").when(role == "assistant", "[BOT]")
            .otherwise(F.concat(F.lit("[ROLE]"), F.coalesce(escape(role), F.lit("[NONE]")), F.lit("[TEXT]"))))


def closing(role: Column) -> Column:
    return F.when(role == "user", "[/INST]").when(role == "assistant", "</s>").otherwise("[/ROLE]")


def merged(turns: Column) -> Column:
    """Blocks of adjacent turns of the same role."""
    def step(blocks: Column, turn: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        same = (F.size(blocks) > 0) & last["role"].eqNullSafe(turn["role"])
        longer = F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))),
                          F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))))
        return F.when(same, longer).otherwise(
            F.concat(blocks, F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))))
    return F.aggregate(turns, F.array().cast(BLOCKS), step)


def pieces(blocks: Column) -> Column:
    """The output in order, as strings marked true where the loss counts."""
    def piece(text: Column, loss: Column) -> Column:
        return F.array(F.struct(text.alias("text"), loss.alias("loss")))

    def block(b: Column, i: Column) -> Column:
        before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
        follows = (i > 0) & before["role"].eqNullSafe(b["role"])
        goes_on = (i < F.size(blocks) - 1) & after["role"].eqNullSafe(b["role"])
        loss = F.coalesce(b["role"] == "assistant", F.lit(False))
        return F.concat(
            piece(F.when(follows, F.lit(NEXT)).otherwise(opening(b["role"])), F.lit(False)),
            F.flatten(F.transform(b["texts"], lambda t, k: F.concat(
                F.when(k > 0, piece(F.lit(NEXT), F.lit(False))).otherwise(F.array().cast(PIECES)), piece(escape(t), loss)))),
            F.when(goes_on, F.array().cast(PIECES)).otherwise(piece(closing(b["role"]), F.lit(False))))
    return F.concat(piece(F.lit(BEGIN), F.lit(False)), F.flatten(F.transform(blocks, block)))


def spans(parts: Column) -> Column:
    """Start and length of the pieces under the loss, in characters and in bytes; running sums in two levels."""
    def moved(s: Column, by: Column) -> Column:
        return F.struct((s["start"] + by["at"]).alias("start"), s["length"].alias("length"),
                        (s["first_byte"] + by["byte"]).alias("first_byte"), s["bytes"].alias("bytes"))

    def run(part: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("byte"), F.array().cast(MASK).alias("spans"))

        def step(acc: Column, p: Column) -> Column:
            n, size = F.length(p["text"]).cast("long"), F.octet_length(p["text"]).cast("long")
            here = F.array(F.struct(acc["at"].alias("start"), n.alias("length"), acc["byte"].alias("first_byte"), size.alias("bytes")))
            return F.struct((acc["at"] + n).alias("at"), (acc["byte"] + size).alias("byte"),
                            F.when(p["loss"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))
        return F.aggregate(part, zero, step)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / 256).cast("int")),
                         lambda j: run(F.slice(parts, j * 256 + 1, 256)))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("byte"), F.array().cast(f"array<{MASK}>").alias("all"))

    def add(acc: Column, c: Column) -> Column:
        return F.struct((acc["at"] + c["at"]).alias("at"), (acc["byte"] + c["byte"]).alias("byte"),
                        F.concat(acc["all"], F.array(F.transform(c["spans"], lambda s: moved(s, acc)))).alias("all"))
    return F.flatten(F.aggregate(chunks, zero, add)["all"])


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length in characters of `formatted`; first_byte, bytes in its UTF-8)."""
    turns = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                        F.col(f"`{role}`").alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    chunks = (turns.groupBy("conv_id", F.floor(F.col("turn") / TURNS_PER_CHUNK).alias("chunk"))
              .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
              .select("conv_id", "chunk", merged(F.col("turns")).alias("blocks")))
    whole = (chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "blocks"))).alias("chunks"))
             .select("conv_id", F.flatten(F.transform("chunks", lambda c: c["blocks"])).alias("blocks"))
             .select("conv_id", pieces(F.col("blocks")).alias("pieces")))
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
                        spans(F.col("pieces")).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order, unescaped."""
    body = F.substr(formatted, F.lit(len(BEGIN) + 1))
    blocks = F.filter(F.split(body, r"(?<=\[/INST\]|</s>|\[/ROLE\])", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        user, bot = F.startswith(b, F.lit("[INST]")), F.startswith(b, F.lit("[BOT]"))
        name = F.substring_index(F.substr(b, F.lit(7)), "[TEXT]", 1)
        role = F.when(user, "user").when(bot, "assistant").when(name != "[NONE]", unescape(name))
        front = F.when(user, 6).when(bot, 5).otherwise(F.length(name) + 12)
        back = F.when(user, 7).when(bot, 4).otherwise(7)
        inner = F.substr(b, front + 1, F.length(b) - front - back)
        return F.transform(F.split(inner, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between.

    Spans are taken by their bytes: a cut by characters would count from the start of the text for every span.
    """
    def texts(raw: Column) -> Column:
        return F.transform(loss_spans, lambda s: unescape(
            F.decode(F.substr(raw, (s["first_byte"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8")))
    # the array of one makes the bytes once for all spans
    return F.array_join(F.get(F.transform(F.array(F.encode(formatted, "UTF-8")), texts), F.lit(0)), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what `parse` and `loss_text` find in the output of `format_chats`."""
    found = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
                             loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
