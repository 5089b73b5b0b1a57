"""Personal data by anchor expansion.

One Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues.
From each anchor a local parser expands to the boundaries and validates what it found, so
that plain text is walked once and no pattern is tried at places without an anchor.

Base kinds (fixed by contract): email, ip, card, phone. Added kinds: iban (mod-97 checked),
login (user and secret inside a URL), secret (a cue such as `password=` or `"password": ` with
its value). Users, secrets and values may have any length; the runs read from two anchors
do not overlap, so that long ones stay linear.
Offsets are code points, ends exclusive. Null and empty texts have no spans; every row is
kept, with repeated rows treated alike; other columns are passed on untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "iban", "login", "secret")
BASE = KINDS[:4]
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))

CUES = ("password", "passwd", "secret", "api_key", "apikey", "token")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9]++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"[ ().0-9-]*[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOGIN = re.compile(r"[^\s/@:\"'<>]++:[^\s/@\"'<>]++@[A-Za-z0-9.-]++")
SECRET = re.compile(r"[\"']?\s*+[=:]\s*+[\"']?([A-Za-z0-9_\-+/.]{8,}+)")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    s = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of one text, by start and then by kind as listed."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    after_email = after_ip = after_card = after_phone = after_iban = after_cue = 0
    for last, (anchor, width) in automaton().iter(text):
        p = last - width + 1
        if anchor == "digit":
            if p >= after_card:
                m = CARD.match(text, p)
                after_card = m.end() if m else p + 1
                if m:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append((p, after_card, "card"))
            if p >= after_ip:
                m = IP.match(text, p)
                after_ip = (m or DIGITS.match(text, p)).end()
                if m and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                    found.append((p, after_ip, "ip"))
            if p - 2 >= after_iban and "A" <= text[p - 1] <= "Z" and (p == 2 or not text[p - 3].isalnum()):
                m = IBAN.match(text, p - 2)
                if m and mod97(m.group().replace(" ", "")):
                    found.append((p - 2, m.end(), "iban"))
                    after_iban = m.end()
        elif anchor == "at":
            s = p
            while s > after_email and text[s - 1] in LOCAL:
                s -= 1
            m = DOMAIN.match(text, p + 1) if s < p else None
            if m:
                found.append((s, m.end(), "email"))
                after_email = m.end()
        elif anchor == "plus":
            if p >= after_phone and text[p + 1 : p + 2] in set("0123456789"):
                m = PHONE.match(text, p + 2)
                if m and len(m.group()) >= 2:
                    after_phone = m.end()
                    if 9 <= sum(c.isdigit() for c in text[p:after_phone]) <= 15:
                        found.append((p, after_phone, "phone"))
        elif anchor == "scheme":
            m = LOGIN.match(text, p + 3)
            if m:
                s = p
                while s and p - s < 20 and text[s - 1].isascii() and text[s - 1].isalnum():
                    s -= 1
                if s < p:
                    found.append((s, m.end(), "login"))
        elif p >= after_cue:
            m = SECRET.match(text, p + width)
            if m and any(c.isdigit() for c in m.group(1)):
                found.append((m.start(1), m.end(1), "secret"))
                after_cue = m.end()
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[0], order[x[2]]))


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


@F.pandas_udf(SPANS)
def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in scan(t)] for t in s], dtype=object)


@F.pandas_udf(T.StringType())
def _masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(mask)


def personal_spans(text: Column) -> Column:
    """Array of (kind, start, end), ordered by start and then by kind as listed in `KINDS`."""
    return _spans(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with personal data in `text` replaced; all other columns stay, null texts stay null."""
    return docs.withColumn(text, _masked(F.col(f"`{text}`")))


def span_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a count for each base kind, digest of the base spans, and all spans as text."""
    spans = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), personal_spans(F.col(f"`{text}`")).alias("s"))

    def joined(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id", *[counted(k) for k in BASE],
        F.sha2(joined(F.filter("s", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"))
