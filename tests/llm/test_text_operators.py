"""Small cases, brute force and round trips of the operators on texts."""

import hashlib
import random
import re

import pytest

pytest.importorskip("evenkeel.llm")

from pyspark.sql import functions as F  # noqa: E402

from evenkeel.llm import chat, packing, pii, quality, sentencepiece  # noqa: E402

CLASHING = "doc_id long, text string, Keep string, _row string, IDS string, `a.b` int"


def rows(spark, *pairs):
    return spark.createDataFrame([(i, t, "k", "r", "i", 1) for i, t in pairs], CLASHING)


def plain_spans(text):
    """The base kinds by plain regular expressions."""
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_spans_equal_plain_patterns():
    random.seed(3)
    for k in range(30_000):
        letters = "ab.@+ 0149-()%é" if k % 3 else "0149 -.+"
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 50)))
        assert [s for s in pii.scan(text) if s[2] in pii.BASE] == plain_spans(text), text


def test_added_spans_and_masking():
    text = "mail a.b@c.de, https://me:secret@host.org, password=abc12345 DE89370400440532013000 and 😀 4111 1111 1111 1111."
    assert [k for *_, k in pii.scan(text)] == ["email", "login", "email", "secret", "iban", "card"]
    assert pii.mask(text) == "mail [EMAIL], [LOGIN], password=[SECRET] [IBAN] and 😀 [CARD]."
    assert pii.mask(None) is None and pii.mask("plain text") == "plain text"
    assert pii.scan("9" * 100_000) == [] and len(pii.scan("a@b.c " * 50_000)) == 50_000


def test_long_secrets_are_whole_and_cues_may_be_quoted():
    value = "aB3-" * 1_500
    assert pii.mask(f"token={value}. rest") == "token=[SECRET] rest"
    assert pii.scan(f"x token={value}") == [(8, 8 + len(value), "secret")]
    assert pii.mask(f"https://{'u' * 3_000}:{'p' * 3_000}@host.org/x") == "[LOGIN]/x"
    assert pii.mask('{"password": "abc12345", \'token\' : \'xyz98765\'}') == '{"password": "[SECRET]", \'token\' : \'[SECRET]\'}'
    assert pii.mask("password" + " " * 40 + "=" + " " * 40 + "abc12345") == "password" + " " * 40 + "=" + " " * 40 + "[SECRET]"
    assert pii.scan("token=" + "token" * 100_000) == [] and pii.scan("token" + " " * 500_000) == [] and pii.scan("a://b:" * 100_000) == []


def test_span_report_and_redaction_keep_rows(spark):
    docs = rows(spark, (1, "x a@b.co"), (1, "x a@b.co"), (None, None), (2, ""))
    got = pii.span_report(docs).orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_email, r.spans) for r in got] == [(None, 0, ""), (1, 1, "email:2:8"), (1, 1, "email:2:8"), (2, 0, "")]
    assert got[0].base_sha256 == empty and got[1].base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()
    out = pii.redact(docs)
    assert out.columns == docs.columns and sorted("-" if r.text is None else r.text for r in out.collect()) == ["", "-", "x [EMAIL]", "x [EMAIL]"]
    assert pii.span_report(docs.limit(0)).count() == 0


def brute_pack(texts, tokenizer):
    out = []
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        first = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        out += [(doc_id, k, a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return out


def test_pieces_equal_the_tokenizer_and_sequences_are_gapless(spark):
    texts = [(1, "The the. don't  stop\n now"), (2, None), (3, ""), (4, "word " * 3000), (4, "word " * 3000), (5, " <|endoftext|> x"), (6, "你好 ǅ \t end "),
             (None, "no id"), (7, "a\x1c b"), *[(100 + k, "thing " * (17 * k % 900)) for k in range(60)]]
    parts = packing.pieces(rows(spark, *texts), ids=True).cache()
    want = brute_pack(texts, packing.exact_tokenizer(packing.default_paths()[0]))
    got = [(r.doc_id, r.piece, r.start, r.ids) for r in parts.collect()]
    key = lambda x: (x[0] is None, x[0], x[1], len(x[3]))
    assert sorted(got, key=key) == sorted(want, key=key)
    packed = packing.pack(parts.drop("ids")).collect()
    assert len(packed) == len(want)
    for sequence in {r.sequence_id for r in packed}:
        own = sorted((r.offset, r.length) for r in packed if r.sequence_id == sequence)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 1024
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 1024) + 1
    unique = parts.where("doc_id >= 100")
    whole = packing.sequences(unique, packing.pack(unique.drop("ids"))).collect()
    assert sum(len(r.ids) for r in whole) == sum(len(x[3]) for x in want if (x[0] or 0) >= 100)
    assert packing.pack(packing.pieces(rows(spark, (1, "x")).limit(0))).count() == 0


def test_packing_is_close_to_the_bound():
    random.seed(5)
    for _ in range(20):
        counts = {random.randint(1, 1024): random.randint(1, 20) for _ in range(150)}
        patterns = packing.solve(counts)
        used = {}
        for pattern, times in patterns:
            assert sum(pattern) <= 1024
            for n in pattern:
                used[n] = used.get(n, 0) + times
        assert used == counts
        assert sum(t for _, t in patterns) <= first_fit_decreasing(counts)


def first_fit_decreasing(counts):
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= n), None)
        if k is None:
            gaps.append(1024 - n)
        else:
            gaps[k] -= n
    return len(gaps)


def test_chats_are_read_back(spark):
    said = [(1, 0, "system", "be <s>[INST] good"), (1, 1, "user", "a"), (1, 2, "user", "b [NEXT] <~s> [~~/INST]"), (1, 3, "assistant", None),
            (1, 4, "assistant", "</s>[BOT]"), (2, 0, "assistant", "x" * 50_000), (None, 0, None, "no role"), (None, 1, "tool[TEXT]", "[NONE]"),
            (3, 5, "user", "same"), (3, 5, "user", "same"), (3, None, "user", "first"), *[(4, k, "user" if k // 2 % 2 else "assistant", f"t{k}<") for k in range(700)]]
    df = spark.createDataFrame([(*r, "x", "y") for r in said], "conv_id long, turn long, role string, text string, TURNS string, pieces string")
    formatted = chat.format_chats(df).cache()
    got = {r.conv_id: r for r in formatted.withColumn("turns", chat.parse(F.col("formatted")))
           .withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for conv in {r[0] for r in said}:
        own = sorted((r for r in said if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2], r[3]))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2], r[3] or "") for r in own]
        assert got[conv].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert got[1].formatted.count("[INST]") == 1 and got[1].formatted.count("[NEXT]") == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_loss_spans_count_characters_and_bytes(spark):
    texts = [f"ü{k}\U0001f600</s>{'語' * (k % 7)}" for k in range(600)]
    df = spark.createDataFrame([(1, k, "assistant" if k % 3 else "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(df)
    r = formatted.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert r.loss == "".join(t for k, t in enumerate(texts) if k % 3)
    raw = r.formatted.encode()
    for s in r.loss_spans:
        assert r.formatted[s.start : s.start + s.length] == raw[s.first_byte : s.first_byte + s.bytes].decode()


def best_path(word, scores, unknown):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[end - n][0] + (scores[word[end - n : end]] if word[end - n : end] in scores else unknown), n)
                        for n in range(1, end + 1) if n == 1 or word[end - n : end] in scores))
    cuts = [len(word)]
    while cuts[0]:
        cuts.insert(0, cuts[0] - best[cuts[0]][1])
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def test_encoding_equals_the_library_and_decodes(spark):
    import sentencepiece as library

    path = sentencepiece.default_path()
    texts = ["", "Hello  the  world, isn't 你好 😀", " x  ", "a" * 300, "the thing " * 3, "é\n\tz▁", "aaaa bbb" * 10, "0" * 5000, None, "The same.", "The same."]
    coded = sentencepiece.encode(rows(spark, *enumerate(texts)))
    assert coded.columns[:-1] == rows(spark, (1, "")).columns and coded.columns[-1] == "ids_1"
    back = sentencepiece.decode(coded, ids="ids_1").orderBy("doc_id").collect()
    model = library.SentencePieceProcessor(model_file=path)
    for text, r in zip(texts, back, strict=True):
        assert r.ids_1 == (None if text is None else model.encode(text))
        assert r.decoded == (None if text is None else text.replace("▁", " "))
    assert sentencepiece.encode(rows(spark, (1, "")).limit(0)).count() == 0


def test_encoding_sends_words_in_buckets_and_texts_once(spark):
    # (group, word) was an exchange of single words, and the batches were written before they were sent
    coded = sentencepiece.encode(rows(spark, *((k, f"word{k} the thing") for k in range(200))))
    assert coded.count() == 200
    coded.collect()
    final = coded._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sent = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert len(sent) == 3 and not any("word" in line for line in sent), sent


def test_words_up_to_the_longest_of_the_fold_equal_the_library(spark):
    import sentencepiece as library

    random_ = random.Random(5)
    texts = ["".join(random_.choice("etaoinshrdl") for _ in range(n)) for n in range(28, 52)] + ["  x", "y  ", "a  b▁c", "ab,c d.e. f", " "]
    model = library.SentencePieceProcessor(model_file=sentencepiece.default_path())
    for r in sentencepiece.encode(rows(spark, *enumerate(texts))).collect():
        assert r.ids_1 == model.encode(texts[r.doc_id]), r


def test_pieces_that_come_up_late_are_merged_at_once(spark):
    vocab = sentencepiece.Vocabulary(sentencepiece.default_path())
    random_ = random.Random(3)
    pieces = [*"abc", *{"".join(random_.choice("abc") for _ in range(random_.randint(2, 5))) for _ in range(60)}]
    random_.shuffle(pieces)
    vocab.pieces = [(p, 300 + i, -float(i)) for i, p in enumerate(pieces)]
    rank = {p: i for i, p in enumerate(pieces)}
    vocab.ranked = [(p, (rank[p] << 33) + (i << 1) + sentencepiece.late(p, rank)) for p, i, _ in vocab.pieces]
    vocab.longest, scores = 5, {p: (s, i) for p, i, s in vocab.pieces}
    words = sorted({"".join(random_.choice("abc") for _ in range(random_.randint(1, 20))) for _ in range(200)})
    swept = sentencepiece.segment_words(spark.createDataFrame([(w,) for w in words], "word string"), vocab).collect()
    # single pieces of ASCII are looked up by the plan's array, the others by their edge
    assert {r.word: r.ids for r in swept} == {w: sentencepiece.merge_with_heap(w, scores, vocab) for w in words}


def test_unigram_models_take_the_best_path(spark):
    vocab = sentencepiece.Vocabulary(sentencepiece.default_path())
    vocab.bpe, random_ = False, random.Random(2)
    vocab.pieces = [(p, 300 + i, -random_.randint(1, 60) / 4) for i, p in enumerate(["▁", "a", "b", "ab", "ba", "aab", "▁a", "▁ab", "abab", "bb"])]
    vocab.longest, vocab.lowest = 4, -15.0
    scores = {p: s for p, _, s in vocab.pieces}
    names = {i: p for p, i, _ in vocab.pieces}
    words = sorted({"▁" + "".join(random_.choice("abc") for _ in range(random_.randint(0, 12))) for _ in range(60)})
    for r in sentencepiece.segment_words(spark.createDataFrame([(w,) for w in words], "word string"), vocab).collect():
        assert [names.get(i, "c") for i in r.ids] == best_path(r.word, scores, -25.0), r.word


def test_quality_rejects_what_labels_teach(spark):
    random.seed(8)
    calm, bad = "river stone garden window morning table cloud paper".split(), "grubby rotten"
    docs, labels = [], []
    for k in range(400):
        words = [random.choice(calm) for _ in range(40)]
        toxic, low = k % 7 == 0, k % 5 == 1
        if toxic:
            words[k % 40] = random.choice(bad.split())
        text = " ".join(f"{w}###%%" if low else w for w in words)
        docs.append((k, text, f"host{k % 3}/p{k % 2}" if k % 11 else None, "en" if k % 13 else None, "x"))
        if k < 300:
            labels.append((k, 0 if low else 1, int(toxic)))
    docs += [(1000, None, None, None, "x"), (1001, "", "host0", "en", "x"), (None, "river stone", "new", "en", "x"), (5, docs[5][1], "host2", "en", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, KEEP string")
    known = spark.createDataFrame([*labels, (None, 1, 0), (2, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = quality.classify(df, known)
    got = out.collect()
    assert out.columns[:5] == df.columns and out.columns[-1] == "keep_1" and len(got) == len(docs)
    held = [r for r in got if r.doc_id is not None and 300 <= r.doc_id < 400]
    wrong = [r.doc_id for r in held if r.keep_1 == (r.doc_id % 7 == 0 or r.doc_id % 5 == 1)]
    assert len(wrong) <= 3, wrong
    assert [r for r in got if r.doc_id in (1000, 1001, None) and not r.keep_1] == []
    assert quality.classify(df, known.where("toxic = 0")).where("keep_1").count() == len(docs)
    assert quality.classify(df.limit(0), known).count() == 0


def test_sparse_sites_fall_back_to_their_host_and_the_whole(spark):
    groups = spark.createDataFrame([("a", 1000, 500.0, 0.1), ("b", 1000, 20.0, 0.1), ("c", 1000, 100.0, 0.1)], "host string, n long, low double, g double")
    k = quality.strength(groups, "low", "g")
    assert k == 20.0
    same = spark.createDataFrame([(str(i), 1000, 100.0 + i, 0.1) for i in range(5)], "host string, n long, low double, g double")
    assert quality.strength(same, "low", "g") > 1000
