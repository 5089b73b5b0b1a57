"""Infilling, filter audit and language identification against brute force and round trips."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("evenkeel.llm")

from pyspark.sql import functions as F  # noqa: E402

from evenkeel.llm import infilling, interactions, language  # noqa: E402

CLASHING = "doc_id long, text string, FORM string, n string, lang_pred string, _cuts int, source string, lang string"


def rows(spark, *triples):
    return spark.createDataFrame([(i, t, "f", "n", "l", 1, s, "en") for i, t, s in triples], CLASHING)


def plain_units(text, unit):
    if unit == "code points":
        return list(text)
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"\A[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|\A[\x20\x09-\x0D]+\Z", text)


@pytest.mark.parametrize("unit", ["code points", "words", "lines"])
@pytest.mark.parametrize("block", [1, 3, 8, 2048])
def test_cuts_equal_plain_counting(monkeypatch, unit, block):
    monkeypatch.setattr(infilling, "BLOCK", block)
    r = random.Random(block)
    for _ in range(300):
        text = "".join(r.choice("ab é😀  \n\t") for _ in range(r.randint(0, 40)))
        raw = np.frombuffer(text.encode(), np.uint8)
        draws = (r.getrandbits(32), r.getrandbits(32))
        units = plain_units(text, unit)
        assert "".join(units) == text
        ends = sorted(d % (len(units) + 1) for d in draws)
        assert infilling.cut_points(raw, draws, unit) == (len(units), *(len("".join(units[:k])) for k in ends)), (text, ends)


def test_descent_equals_running_sums():
    r = random.Random(1)
    for size in (1, 2, 3, 7, 8, 9, 100):
        units, points = np.array([r.randint(0, 3) for _ in range(size)]), np.array([r.randint(0, 9) for _ in range(size)])
        tree, sums = infilling.Fenwick(units, points), np.cumsum(units)
        for k in range(int(sums[-1])):
            at = int(np.searchsorted(sums, k, "right"))
            assert tree.descend(k) == (at, int(units[:at].sum()), int(points[:at].sum()))


def test_infilling_is_exact_and_comes_back(spark):
    texts = [None, "", "x", "long <S> text", "<P", "a<", ">b", "P>" * 20, "<M>", "é😀\n" * 3_000, *["<word " * k for k in range(1, 60)], "same", "same"]
    df = rows(spark, *[(k, t, None) for k, t in enumerate(texts)], (None, "no id", None), (3, "again <P", None))
    out = infilling.infill(df)
    assert out.columns == [*df.columns, "n_1", "form_1", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", infilling.restore(F.col("output"), F.col("form_1"))).collect()
    forms = set()
    for r in got:
        t = r.text or ""
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        want = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        assert (r.n_1, r.form_1, r.output, r.back) == (len(t), form, want, t)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (a, b - a))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"} and len(got) == len(texts) + 2
    assert infilling.infill(df, unit="words").where("form_1 <> 'plain'").withColumn("back", infilling.restore(F.col("output"), F.col("form_1"))).where("back = text").count() > 30
    assert infilling.report(df.limit(0)).count() == 0


def test_audit_equals_walking_through_every_order(spark):
    r = random.Random(6)
    docs = [(p, r.randrange(32) if k % 3 else 0, bool(k % 2), bool(k % 5 == 0), r.randint(1, 4)) for p in ("", "a", "b") for k in range(25)]
    docs.append(("clean", 0, True, False, 7))
    got = interactions.audit(spark.createDataFrame(docs, "part string, mask int, good boolean, toxic boolean, n long")).collect()
    assert len(got) == 4 * 600
    shares: dict = {}
    for order in permutations("ABCDE"):
        gone = {}
        for part, mask, good, toxic, n in docs:
            fails = [x for k, x in enumerate("ABCDE") if mask >> k & 1]
            gone.setdefault(part, []).append((fails, min((order.index(x) for x in fails), default=9), good, toxic, n))
        for part, own in gone.items():
            for k, x in enumerate(order):
                removed = sum(d[4] for d in own if d[1] == k)
                shares[part, "".join(order), k + 1] = (
                    sum(d[4] for d in own if d[1] > k), removed, sum(d[4] for d in own if d[1] < k and x in d[0]), sum(d[4] for d in own if d[0] == [x]),
                    sum(d[4] for d in own if d[1] == k and d[2]), sum(d[4] for d in own if d[1] == k and d[3]))
                shares[part, x] = shares.get((part, x), 0) + removed
    for row in got:
        assert tuple(row[3:9]) == shares[row.part, row.filter_order, row.step] and row.shapley == shares[row.part, row.filter_order[row.step - 1]]


def test_failures_of_rows_with_gaps(spark):
    long = " ".join(f"w{k}" for k in range(60))
    df = rows(spark, (1, long, "s"), (2, long, "s"), (2, long, "s"), (3, "AB # c", None), (None, long, "s"), (4, None, "s"), (5, "", "t"), (4, "", "s"), (9, " ".join(["x"] * 60), "t"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (2, 1, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.mask, r.good, r.toxic): r.n for r in interactions.failures(df, labels).collect()}
    assert got == {("s", 0, True, False): 1, ("s", 16, True, True): 2, ("s", 0, False, False): 1, ("", 1 + 4 + 8, False, False): 1,
                   ("s", 1, False, False): 2, ("t", 1 + 16, False, False): 1, ("t", 2, False, False): 1}
    assert interactions.audit(interactions.failures(df.limit(0), labels)).count() == 0


def test_languages_are_told_apart_on_texts_not_learned_from(spark):
    r = random.Random(3)
    endings = {"xa": "ando mento zione".split(), "yb": "heit keit ung".split(), "zc": "ough tion ness".split()}
    stems = {k: ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(300)] for k in endings}
    def text(k, n):
        return " ".join(r.choice(stems[k]) + r.choice(endings[k]) for _ in range(n))
    docs = [(i, text(k := "xa yb zc".split()[i % 3], 400 if i % 40 == 0 else 40), k) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    learned = language.learn(df.where("doc_id < 600"))
    assert sorted(learned.names) == ["xa", "yb", "zc"] and all(1_000 < len(d) <= language.DICTIONARY for d in learned.dictionaries)
    assert language.learn(df.where("doc_id < 600").repartition(7)) == learned
    got = language.identify(df.where("doc_id >= 600"), learned).collect()
    assert sum(x.lang_pred == x.lang for x in got) >= 0.99 * len(got) and all(0 <= x.score <= 1 for x in got) and any(x.sure for x in got)


def test_texts_without_letters_and_narrow_leads(spark):
    df = rows(spark, (1, None, "s"), (2, "", "s"), (3, " 12 - !?\n", "s"), (4, "é", "s"), (5, "x" * 100_000, "s"), (None, "Ab", "s"), (5, "x" * 100_000, "s"))
    model = language.Languages(("many", "few"), (b" the house of words", b" the house of words"))
    out = language.identify(df, model)
    assert out.columns == [*df.columns, "lang_pred_1", "score", "sure"]
    got = sorted(((r.doc_id or 0, r.lang_pred_1, r.score, r.sure) for r in out.collect()))
    assert got == [(0, "many", 0.0, False), (1, "und", 0.0, False), (2, "und", 0.0, False), (3, "und", 0.0, False), (4, "many", 0.0, False),
                   (5, "many", 0.0, False), (5, "many", 0.0, False)]
    one = language.identify(df, language.Languages(("only",), (b"words",))).where("doc_id = 4").first()
    assert (one.lang_pred_1, one.score) == ("only", 1.0)
    none = language.identify(df, language.learn(df.limit(0))).where("doc_id = 4").first()
    assert (none.lang_pred_1, none.score) == ("und", 0.0)
    assert language.report(df.limit(0)).count() == 0 and language.report(df).count() == 7


def test_held_out_documents_of_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 250 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
