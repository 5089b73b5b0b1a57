"""Small cases and brute force of the operators on pairs, vectors, pages and of the pipeline."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("evenkeel.llm")

from pyspark.sql import functions as F  # noqa: E402

from evenkeel.llm import hamming, html, jaccard, shingles, topk, warc  # noqa: E402
from evenkeel.llm.components import components  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, REP string, e string"


def union(n, links):
    top = {x: x for x in n}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


def test_components_of_paths_stars_and_rings(spark):
    random.seed(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1100)] + [(random.randint(2000, 2060), random.randint(2000, 2060)) for _ in range(45)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")).collect()}
    want = union({x for e in edges for x in e}, edges)
    assert got == {x: c for x, c in want.items() if x in {y for e in edges if e[0] != e[1] for y in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def set_of(text, size):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def test_shingle_sets_equal_plain_sets():
    random.seed(2)
    texts = ["", " ", None, "a", "B a", "a b c d", "A b\tc D\x0be", "a\xa0b c d é É", "x " * 50, "\n lead in g", "z" * 100_000]
    texts += ["".join(random.choice("ab C\n") for _ in range(random.randint(0, 60))) for _ in range(500)]
    for size in (1, 4, 5):
        flat, sizes = shingles.shingle_sets(pa.array(texts, pa.string()), size)
        own = np.split(flat, np.cumsum(sizes)[:-1])
        for i in range(0, len(texts), 3):
            for j in range(i, len(texts), 17):
                assert len(np.intersect1d(own[i], own[j])) == len(set_of(texts[i], size) & set_of(texts[j], size)), (texts[i], texts[j])


@pytest.mark.parametrize("size", range(1, 9))
def test_batches_of_few_words_have_sets(size):
    for total in range(size + 3):
        for texts in ([" ".join("ab"[k % 2] for k in range(total))], [None, "a " * (total // 2), "", "b " * (total - total // 2), " "], ["c"] * total, ["", None]):
            flat, sizes = shingles.shingle_sets(pa.array(texts, pa.string()), size)
            assert sizes.tolist() == [len(set_of(t, size)) for t in texts] and len(flat) == sizes.sum()


def test_tables_of_short_texts_are_grouped(spark):
    texts = ["two words", "Two  words", "one", "", None, "a b c", "a b c d", "a b c d e", "a B c d e", "one two", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, percent in ((4, 85), (5, 80)):
        for part in (df, df.repartition(11, "doc_id"), df.where("doc_id = 0")):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(part, size, percent).collect()}
            first: dict = {}
            for i in sorted(got):
                own = frozenset(set_of(texts[i], size))
                assert got[i] == (len(own), first.setdefault(own, i) if own else i)


def test_frequencies_in_one_byte_keep_their_order():
    df = np.unique(np.r_[np.arange(1, 5_000), 2 ** np.arange(13, 40), 2 ** np.arange(13, 40) - 1])
    levels = jaccard.level(df)
    assert (np.diff(levels.astype(int)) >= 0).all() and (levels[:127] == df[:127]).all()
    low = df < 1 << 20
    assert (jaccard.power(levels[low]) == np.frexp(df[low].astype(float))[1]).all()
    tokens = np.array([0, 5, 2**47 - 1], np.uint64)
    assert (jaccard.wide(jaccard.narrow(tokens, 6), 6) == tokens.view(np.int64)).all() and jaccard.token_width(1) == 5 and jaccard.token_width(70_000) == 7


def near_texts():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = {}
    for k in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(3, 150))]
        if k % 3 == 0:
            words += passage
        for c in range(r.choice([1, 1, 2, 6])):
            own = list(words)
            for _ in range(c % 4):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts[len(texts)] = " ".join(own)
    base = [r.choice(vocabulary) for _ in range(120)]
    for k in range(400):  # near copies, most of them too far from each other
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        texts[len(texts)] = " ".join(own)
    rows = [*texts.items(), (2000, texts[0].upper()), (2001, None), (2002, ""), (2003, " \n"), (2004, "one two"), (2005, "ONE two"), (2006, texts[1]), (2006, texts[1]), (None, texts[1])]
    return rows


def brute_groups(rows, size, percent):
    known = [(i, set_of(t, size)) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(known) for b, y in known[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return union({i for i, _ in known}, links)


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_groups_equal_brute_force(spark, monkeypatch, size, percent):
    monkeypatch.setattr(jaccard, "TOKENS_PER_RANGE", 5_000)
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 50)
    rows = near_texts()
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, Rep string, n int, token int").repartition(3)
    got = jaccard.jaccard_groups(df, size, percent).collect()
    want = brute_groups(rows, size, percent)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {*want.items(), (None, None)}
    by_id = {i: len(set_of(t, size)) for i, t in rows}
    assert all(r.n_shingles == by_id[r.doc_id] for r in got)
    assert jaccard.jaccard_groups(df.limit(0), size, percent).count() == 0


def test_meetings_in_small_blocks_lose_no_link(spark):
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    caught = {}
    plain = jaccard.linked

    def keep(shared, percent, width):
        caught["shared"], caught["width"] = shared, width
        return plain(shared, percent, width)
    try:
        jaccard.linked = keep
        jaccard.jaccard_groups(df).count()
    finally:
        jaccard.linked = plain
    shared = caught["shared"]
    nobody = spark.createDataFrame([], "id long, component long")
    got = components(jaccard.between_components(shared, nobody, 85, caught["width"], block=16)).collect()
    reps = {r.doc_id for r in shared.select("doc_id").collect()}
    want = brute_groups([(i, t) for i, t in rows if i in reps], 4, 85)
    assert {(r.id, r.component) for r in got} == {(i, c) for i, c in want.items() if sum(c == d for d in want.values()) > 1}


def vectors(spark):
    r = np.random.default_rng(6)
    out = []
    for k in range(300):
        v = r.normal(size=16)
        for c in range(int(r.integers(1, 4))):
            out.append((len(out), (v + c * r.normal(size=16) * 0.05).astype(np.float32).tolist(), k % 3))
    out += [(len(out) + k, (out[0][1]), 0) for k in range(40)] + [(5000, [2 * x for x in out[0][1]], 0), (5001, out[0][1], 1), (5002, out[0][1], None), (5003, None, 0),
            (5004, [], 0), (5005, [0.0] * 16, 0), (5006, [float("nan")] * 16, 0), (5007, [None] * 16, 0), (5008, [1.0, 0.0], 0), (5009, [2.0, 0.0], 0), (3, out[3][1], out[3][2]), (None, out[0][1], 0)]
    return out, spark.createDataFrame([(*x, "r", "e") for x in out], VECTORS)


@pytest.mark.parametrize(("tables", "radius"), [(None, None), (4, 1)])
def test_vector_links_equal_brute_force(spark, tables, radius):
    rows, df = vectors(spark)
    got = hamming.near_duplicates(df, tables=tables, radius=radius, block=16).collect()
    usable = [(k, i, np.array(v, float), y) for k, (i, v, y) in enumerate(rows)
              if i is not None and y is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = [(k, m) for k, _, u, y in usable for m, _, v, z in usable
             if k < m and y == z and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98]
    degree = [sum(k in e for e in links) for k in range(len(rows))]
    group = union({i for i, _, _ in rows if i is not None}, [(rows[a][0], rows[b][0]) for a, b in links if rows[a][0] != rows[b][0]])
    assert len(got) == len(rows)
    assert sorted((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(
        (i is None, i, d, group.get(i), i is not None and group[i] == i) for (i, _, _), d in zip(rows, degree, strict=True))
    assert hamming.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("common", "least"), [(0.0, 0.998), (0.2, 0.998), (50.0, 1.0)])
def test_links_at_the_threshold_are_found_at_every_size(spark, monkeypatch, common, least):
    """Pairs at cosine 0.98 to 0.982, also of vectors with a common mean; `MANY` once switched to a setting that lost more of them."""
    monkeypatch.setattr(hamming, "MANY", 1, raising=False)
    r = np.random.default_rng(8)
    u = hamming.unit(r.normal(size=(1_500, 64)) + common)
    w = r.normal(size=u.shape)
    w = hamming.unit(w - (w * u).sum(1, keepdims=True) * u)
    c = r.uniform(0.98001, 0.982, (len(u), 1))
    rows = np.concatenate([u, c * u + np.sqrt(1 - c * c) * w])
    label = np.arange(len(rows)) % 5
    df = spark.createDataFrame([(k, v.tolist(), int(y)) for k, (v, y) in enumerate(zip(rows, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = sum(x.n_links for x in hamming.near_duplicates(df).collect())
    near = (rows @ rows.T >= 0.98) & (label[:, None] == label)
    want = int(near.sum()) - len(rows)
    assert want >= 2 * 1_500 and least * want <= got <= want, (got, want)


def test_top_k_equals_brute_force(spark):
    rows, df = vectors(spark)
    whole = topk.quantised(df)
    got = topk.top_k(whole, whole.where("vec_id % 20 = 0"), k=7, rows_per_block=200, queries_per_block=10).collect()
    usable = [(i, np.floor(64 * np.pad(np.array(v, float), (0, 16 - len(v)))).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    want = set()
    for q, x in usable:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in usable if i != q)[:7]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    few = whole.where("vec_id in (0, 1)")
    assert topk.top_k(few, few, k=7).count() == 2
    assert topk.top_k(whole.limit(0), whole, k=7).count() == 0


def test_scores_of_large_components_are_exact(spark):
    r = random.Random(2)
    rows = [(1, [300_000.0, 0.0]), (2, [400_000.0, 0.0]), (0, [1.0, 1.0])]
    rows += [(k, [r.choice([-1, 1]) * 10 ** r.uniform(0, 15) for _ in range(5)]) for k in range(3, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = topk.quantised(df)
    got = [tuple(x) for x in topk.top_k(q, q.where("vec_id % 20 = 0"), k=7, rows_per_block=16, queries_per_block=2).orderBy("query_id", "rank").collect()]
    from math import floor
    held = {i: [floor(64 * x) for x in v] for i, v in rows}
    want = []
    for i in (0, 20, 40):
        best = sorted((-sum(a * b for a, b in zip(held[i], held[j], strict=False)), j) for j in held if j != i)[:7]
        want += [(i, k, j, max(-(2**63), min(2**63 - 1, -s))) for k, (s, j) in enumerate(best, 1)]
    assert got == want and any(s == 2**63 - 1 for *_, s in got)


def test_archives_are_read_back(spark, tmp_path):
    pages = [(1, "http://a/b", "<p>same</p>"), (0, "u\r\nx", "<p>same</p>"), (2, None, None), (3, "v", ""), (4, "w", "é" * 100_000), (5, "x", "one"), (5, "x", "one"),
             (None, "n", "<p>same</p>"), (None, "n", "alone"), *[(100 + k, f"http://h/{k}", f"<html>{'word ' * (k % 50)}{k}</html>") for k in range(300)]]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, Sha1 string").repartition(3)
    manifest = warc.write_archives(df, str(tmp_path / "archives"))
    got = warc.read_archives(spark, manifest).collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        to = first.get(h or "")
        new = to is None or to == i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if new else "revisit", None if new else to, body if new else None))
    key = lambda x: (x[0] is None, x[0], x[2], x[3])
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got], key=key) == sorted(want, key=key)
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), str(tmp_path / "none"))).count() == 0
    large = warc.read_archives(spark, warc.write_archives(df, str(tmp_path / "large"), min_bytes=100)).where("record_type = 'revisit'")
    assert large.count() == 0


def test_damaged_archives_are_refused(tmp_path):
    import io

    import zstandard

    raw = warc.record(1, "u", b"payload", warc.base32_sha1(b"payload"), None)
    assert warc.parse(raw)["payload"] == b"payload"
    for bad in (raw.replace(b"WARC/1.1", b"WARC/9.9"), raw.replace(b"payload", b"Payload"), raw[:-1], raw.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.Damaged):
            warc.parse(bad)
    frame = zstandard.ZstdCompressor().compress(raw)
    assert list(warc.frames(io.BytesIO(frame + frame), chunk=7)) == [raw, raw]
    with pytest.raises(warc.Damaged):
        list(warc.frames(io.BytesIO(frame + frame[:-3])))
    with pytest.raises(warc.Damaged):
        list(warc.frames(io.BytesIO(b"plain bytes")))


def test_blocks_of_a_page():
    page = ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- c --><p>One &amp; <b>two</b>\n three<br>four<p>five"
            "<ul><li>a<li>b</ul><div hidden>no</div><p class='x'>cut &am")
    assert [b.text for b in html.blocks(page)] == ["One & two three four", "five", "a", "b", "cut &am"]
    assert [b.text for b in html.blocks("<p title=it's>one</p><p title='a > b'>don't</p><a href=\"x>y\">z</a><p class=\"cut")] == ["one", "don't", "z"]
    assert html.blocks(None) == [] and html.blocks("") == [] and len(html.blocks("<p>x" * 20_000)) == 20_000
    assert [b.text for b in html.blocks("<b>" * 5_000 + "deep")] == ["deep"]


def test_paths_are_whole_under_many_class_words():
    many = " ".join("".join(chr(97 + (k // d) % 26) for d in (1, 26)) + "q" for k in range(30))
    page = f'<nav class="{many}"><div class="{many} zz"><ul class="{many}"><li class="{many}"><a href=x class="{many}">one<p class="{many}">two</p></a></ul></div></nav><p>three'
    got = html.blocks(page)
    assert [b.text for b in got] == ["one", "two", "three"] and all({"nav", "div", "ul", "li", "a"} <= {*b.path} for b in got[:2])
    assert got[1].linked == 3 and got[2].path == ("p",) and all(len({*b.path}) == len(b.path) for b in got)
    deep = html.blocks("<article><p>in</p>" + "<div>" * 300 + "far" + "</div>" * 300 + "</article><p>out")
    assert [("article" in b.path) for b in deep] == [True, True, False] and deep[2].path == ("p",)
    assert [b.path for b in html.blocks("<p><li>" + "<b>" * 50_000 + "<h1>" * 50_000 + "</i>" * 50_000 + "x")] == [("p", "li", "h1")]


def test_attribute_values_hide_nothing_and_no_tag_takes_the_rest():
    def read(page):
        return [b.text for b in html.blocks(page)]
    assert read('<div class="flex hidden md"><p>Article text here.</p></div>') == ["Article text here."]
    assert read('<p title="the hidden door">Kept?</p><p data-a="x display: none y">styled</p><p alt=hidden>z</p>') == ["Kept?", "styled", "z"]
    assert read('<p hidden>a</p><p aria-hidden="true">b</p><p style="color:red; display : none">c</p><p HIDDEN=>d</p>x<p aria-hidden=false>e') == ["x", "e"]
    assert read("<p>e=<math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> holds</p>") == ["e=mc2 holds"]
    for tag in ("svg", "math", "object", "button", "select", "noscript", "canvas", "audio", "video"):
        assert "".join(read(f"<p>x <{tag}> never closed <p>rest of article</p>")).replace(" ", "") == "xneverclosedrestofarticle", tag
        got = html.blocks(f"<article><p>x <{tag}>in</{tag}></p><p>after</p></article><p>out")
        assert got[-1].path == ("p",) and tag not in got[-2].path
    assert read('<p>a <svg viewBox="0 0 1 1"><title>t</title><path d="M0"/><g><path/></g></svg> b</p><p>c') == ["a b", "c"]
    assert html.blocks("<p>a<svg><path d=x/></svg><p>b")[-1].path == ("p",)
    assert read("<div>a <svg> b</div>c") == ["a b", "c"]
    assert read("<p>a</p><script>x<p>lost") == ["a"] and read("<noscript><p>seen</p></noscript>") == ["seen"]


def independent_text(page):
    """Words outside raw elements by the standard library's parser, with those under `article` marked."""
    from html.parser import HTMLParser

    out, depth = [], {"article": 0, "raw": 0}

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            depth["article"] += tag == "article"
            depth["raw"] += tag in ("script", "style", "title", "textarea", "iframe", "template")

        def handle_endtag(self, tag):
            depth["article"] -= tag == "article" and depth["article"] > 0
            depth["raw"] -= tag in ("script", "style", "title", "textarea", "iframe", "template") and depth["raw"] > 0

        def handle_data(self, data):
            if not depth["raw"]:
                out.extend((w, depth["article"] > 0) for w in data.split())
    reader = Reader()
    reader.feed(page)
    reader.close()
    return out


def test_blocks_lose_no_word_of_the_pages(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        own = [(w, "article" in b.path) for b in html.blocks(r.html) for w in b.text.split()]
        assert "".join(w for w, a in own if a) == "".join(w for w, a in independent_text(r.html) if a)
        assert "".join(w for w, _ in own) == "".join(w for w, _ in independent_text(r.html))


# Written by hand; what stands in [[ ]] is the article.
HAND_MADE = [
    """<body class="home page-template"><header id=top><a href=/>Daily Paper</a><nav class="main-nav"><a href=/a>Politics</a><a href=/b>Sports</a></nav></header>
    <div class="cookie-bar"><p>We use cookies to improve the site. <button>Accept</button></p></div><main><article class="story"><h1>[[Bridge reopens after repairs]]</h1>
    <p class="lead">[[The old bridge over the river was opened to traffic again on Monday.]]</p><p>[[Engineers had worked on it for two years, the city said.]]</p>
    <aside class="related"><h3>Read also</h3><ul><li><a href=/1>Tunnel closed</a></li><li><a href=/2>Road works</a></li></ul></aside>
    <p>[[Tolls are to stay as they were.]]</p></article><section id="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>About time, I wrote to them twice.</p></div></section></main>
    <footer><p>Copyright 2020 Daily Paper, all rights reserved</p></footer></body>""",
    """<div id="wrapper" class="px-4 md:flex hidden-xs"><div class="topbar"><ul><li><a href=/>Home</a></li><li><a href=/shop>Shop</a></li></ul></div><div class="content"><div class="post entry-content">
    <h1>[[How to keep basil]]</h1><p>[[Put it into a glass of water and keep it warm.]]</p><div class="advert">Buy our herb scissors now, 20% off</div><ul><li>[[Change the water daily.]]</li>
    <li>[[Cut the stems at an angle.]]</li></ul><blockquote>[[Never put basil in the fridge.]]</blockquote></div></div><div class="sidebar widget"><h4>Popular posts</h4><p>Ten kinds of mint</p></div>
    <div class="newsletter"><form><label>Your email</label><input name=e><button>Subscribe</button></form></div><div id="footer">Terms and privacy</div></div>""",
]


def test_hand_made_pages_are_read_right():
    model = html.train(["Some words of a page.", "A second, longer line of text that goes on for a while and ends here.", "third one", "It was said that nothing else would be built there."], pool=1_500)
    right = total = 0
    for page in HAND_MADE:
        want = {w.strip() for w in __import__("re").findall(r"\[\[(.*?)\]\]", page, 16)}
        found = html.blocks(page.replace("[[", "").replace("]]", ""))
        p = model.score([found])[0]
        right += sum((x > 0.5) == (b.text in want) for b, x in zip(found, p, strict=True))
        total += len(found)
    assert right >= 0.9 * total, (right, total)


def test_gradients_are_right():
    draw = html.Layouts([], 3)
    pages = [draw.page() for _ in range(3)]
    model = html.Labeller(seed=1)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    features, lengths = html.Features([b for b, _ in pages]), [len(b) for b, _ in pages]
    y = np.concatenate([v for _, v in pages])
    _, g = model.gradients(features, lengths, y)
    r = np.random.default_rng(0)
    for name in ("wx0", "wh0", "wx1", "wh1", "b1", "out"):
        at = tuple(int(r.integers(n)) for n in model.w[name].shape)
        held, step, loss = model.w[name][at], 1e-3, []
        for d in (step, -step):
            model.w[name][at] = held + d
            loss.append(model.gradients(features, lengths, y)[0])
        model.w[name][at] = held
        assert abs((loss[0] - loss[1]) / (2 * step) - g[name][at]) < 2e-3, name


def test_labeller_finds_the_article(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(html, "POOL", 2_000)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    extra = spark.createDataFrame([(9000, None, None), (9001, "u", ""), (9002, "u", "<script>x</script>")], "page_id long, url string, html string")
    got = html.main_text(pages.unionByName(extra), html.fit(pages)).collect()
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in got:
        want = "\n".join(b.text for b in html.blocks(raw.get(r.page_id)) if "article" in b.path)
        assert r.text == want and r.n_chars == len(want), r.page_id
    assert len(got) == len(raw) + 3
    model = html.train([b.text for x in list(raw.values())[:40] for b in html.blocks(x)], pool=2_000)
    draw = html.Layouts(["Some other words, not seen before.", "And a second line of text that is longer than the first one."], 77)
    held = [x for x in (draw.page() for _ in range(150)) if x[0]]
    right = [(s > 0.5) == (y > 0.5) for s, (_, y) in zip(model.score([b for b, _ in held]), held, strict=True)]
    assert np.concatenate(right).mean() > 0.97


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    r = random.Random(9)
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = pipeline.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset"} <= {*out.columns}
    kept = pipeline.good_documents(spark, docs, folder)
    assert kept.columns == docs.columns
    base = [r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(90)) for _ in range(80)]
    made = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, "write to a@b.co or 10.0.0.1 today my friend"), (4, None), (3, "write to a@b.co or 10.0.0.1 today my friend"), (None, "x"), (None, "x")]
    df = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    one = pipeline.one_of_each_group(spark, df, folder)
    assert one.columns == df.columns and sorted((x.doc_id is None, x.doc_id) for x in one.collect()) == [(False, 1), (False, 3), (False, 4), (True, None)]
    apart = [(3, "not at all like the other text of that id"), (8, " ".join(base)), (8, "one more text with an id that comes twice"), (None, "Only Here"), (None, " ".join(base)), (9, ""), (9, "")]
    more = spark.createDataFrame([*df.collect(), *[(i, t, "en", "s", 7) for i, t in apart]], df.schema)
    got = sorted(((x.doc_id or 99, x.text or "") for x in pipeline.one_of_each_group(spark, more, folder).collect()))
    assert got == sorted([(1, made[0][1]), (3, made[2][1]), (3, apart[0][1]), (4, ""), (8, apart[2][1]), (9, ""), (9, ""), (99, "Only Here"), (99, "x")])
    clean = {x.doc_id: x for x in pipeline.without_personal_data(spark, one, folder).collect()}
    assert clean[3].text == "write to [EMAIL] or [IP] today my friend" and clean[3].n_chars == len(clean[3].text) and clean[4].n_chars is None
    assert pipeline.packed(spark, one, folder).count() == 4


def test_rows_without_others_are_whole(spark):
    from evenkeel.llm.common import without

    rows = spark.range(-3_000, 3_000).selectExpr("id AS k", "concat('t', id) AS _bucket", "id % 7 AS `a.b`")
    others = rows.where("k % 3 = 0").select("k").unionByName(spark.range(50_000, 50_100).toDF("k"))
    for bits in (1 << 15, 1 << 31):
        got = without(rows.unionByName(rows.where("k < 10")), others, "k", most_bits=bits)
        assert got.columns == rows.columns
        assert sorted(r.k for r in got.collect()) == sorted([k for k in range(-3_000, 3_000) if k % 3] + [k for k in range(-3_000, 10) if k % 3])
    assert without(rows, others.limit(0), "k").count() == 6_000 and without(rows.limit(0), others, "k").count() == 0


def test_samples_and_best_rows_do_not_depend_on_partitions(spark):
    from evenkeel.llm.common import best_rows, hash_sample

    df = spark.range(5_000).withColumn("score", F.log2(F.col("id") + 1))
    one, other = (sorted(r.id for r in hash_sample(df.repartition(n), F.col("id"), 100).collect()) for n in (1, 7))
    assert one == other and len(one) == 100
    assert hash_sample(df.limit(0), F.col("id"), 100).count() == 0 and hash_sample(df, F.col("id"), 9_000).count() == 5_000
    top = [r.id for r in best_rows(df, "score", 700).collect()]
    assert 400 < len(top) <= 700 and min(top) == 5_000 - len(top)
    assert best_rows(df.limit(0), "score", 5).count() == 0
