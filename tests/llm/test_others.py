"""Chats, pages and vectors."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewell.llm import chat, main_text, neighbours, queries

SIGNS = ["\\", "#", "##", "###", "### ", "</turn>", "<\\/turn>", "<", "/turn>", ":", ": ", "<\\c>", "user", "é", "😀", "\n", " ", "#\\#"]


def test_chats_can_be_read_back(spark):
    rnd = random.Random(4)
    sign = lambda k: "".join(rnd.choices(SIGNS, k=k))
    rows = [
        (c if c % 30 else None, rnd.choice([t, t, None, 3]), rnd.choice(["user", "assistant", "assistant", None, "a: b\\", sign(3)]), rnd.choice([None, sign(rnd.randint(0, 8))]))
        for c in range(120)
        for t in range(rnd.randint(1, 10))
    ]
    rows += [(999, t, rnd.choice(["user", "assistant"]), f"t{t}") for t in range(700)] + rows[:3]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS slice", "2 AS blocks", "3 AS one")
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append(((t is not None, t or 0, (r or "").encode()), r or "", x or ""))
    got = chat.masked(chat.read_chats(chat.format_chats(turns))).collect()
    assert {r.conv_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        read = [(t.role, t.text) for t in r.turns]
        expected = sorted(want[r.conv_id], key=lambda x: x[0])
        assert [a for a, _ in read] == [x[1] for x in expected]
        assert Counter(read) == Counter(x[1:] for x in expected)
        assert r.loss == "".join(t for a, t in read if a == "assistant")
        assert [r.formatted[s.start : s.start + s.length].encode() for s in r.loss_spans] == [r.formatted.encode()[s.first_byte : s.first_byte + s.bytes] for s in r.loss_spans]
        headers = sum(a != b for a, b in zip([x[0] for x in read][1:], [x[0] for x in read][:-1], strict=True)) + 1
        assert r.formatted.count(chat.HEADER) == headers
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_op1(spark, sf_dir):
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op1_chat_formatting(spark, sf_dir).collect()}
    raw = pd.read_parquet(f"{sf_dir}/conversations.parquet").sort_values(["conv_id", "turn"])
    text = "\\### Assistant: </turn> ok"
    raw = pd.concat([raw, pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [text, text]})])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, g in raw.groupby("conv_id"):
        loss = "".join(t for r, t in zip(g.role, g.text, strict=True) if r == "assistant")
        assert got.pop(c) == (len(g), sha("".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text, strict=True))), len(loss), sha(loss))
    assert not got


def test_chat_plan_is_native(spark, sf_dir):
    plan = queries.op1_chat_formatting(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site</header><div id="sidebar">side<p>x</div>
<main><h1>T &amp; U</h1><p class="ad big">buy<p>One <i>two</i>three<br>four&nbsp;five<div class="comments"><p>c1</div><form>f<input></form>
<section>Six<!-- <p>no</p> --><ul><li>a<li>b</ul></section><script>var a="</main>";</script><p hidden>h<p>last</main><footer>&copy; foot</footer></body></html>"""


def test_blocks_of_a_page():
    main = [t for kind, t in main_text.page_blocks(PAGE) if kind == main_text.MAIN]
    assert main == ["T & U", "One twothree", "four five", "Six", "a", "b", "last"]
    assert main_text.page_blocks("a < b <p>x <y z=\"1>q</p> tail") == [(1, "a < b"), (1, "x"), (1, "q"), (1, "tail")]
    assert main_text.page_blocks("<article><span class=ad>q<b>r</span>s</article>") == [(2, "qr"), (0, "s")]
    assert main_text.page_blocks("") == main_text.page_blocks("<script>x") == main_text.page_blocks("<!-- x") == []
    assert main_text.page_blocks("<article>1 &lt; 2 &#233;</article></div></p>x") == [(0, "1 < 2 é"), (1, "x")]


def test_repeats_decide_about_unmarked_pages(spark):
    same = "<div>Welcome to our site please read the terms of use now</div><div>short bar</div>"
    rows = [(i, f"http://H.example:80/{i}", f"<body>{same}<div>page {i} has own words {i}</div></body>") for i in range(6)]
    rows += [(7, "http://h.example/7", None), (8, None, ""), (9, "u", "<article>a b</article>"), (9, "u", "<article>a b</article>")]
    rows += [(None, "http://other/", f"<p>Welcome to our site please read the terms of use now</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS page", "2 AS host", "3 AS name")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in main_text.main_text(pages).collect())
    own = [f"page {i} has own words {i}" for i in range(6)] + ["", "", "a b", "a b", "Welcome to our site please read the terms of use now"]
    assert got == Counter((p, u, t, len(t)) for (p, u, _), t in zip(rows, own, strict=True))
    assert main_text.main_text(pages.limit(0)).count() == 0


def test_op3(spark, sf_dir):
    import html
    import re

    raw = pd.read_parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: tuple(r) for r in queries.op3_html_extraction(spark, sf_dir).collect()}
    assert len(got) == len(raw)
    for p, url, page in zip(raw.page_id, raw.url, raw.html, strict=True):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<(?:/?(?:p|h1)|br)>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[p] == (p, url, text, len(text))


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(5, 64))
    y = neighbours.rotated(x, 3, 7)
    assert np.allclose(x @ x.T, y @ y.T)
    assert np.allclose(neighbours.hadamard(np.eye(4)) * 2, [[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])


def full_search(rows, k):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            best = {}
            for v, y in rows:
                if v != q:
                    best[v] = max(best.get(v, -np.inf), (np.array(x) * np.array(y)).sum())
            out.setdefault(q, []).append(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k])
    return out


def test_small_tables_are_searched_whole(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, (rnd.normal(size=6) * rnd.choice([0.1, 1, 5])).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]
    odd = [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (None, [1.0] * 6)]
    vectors = spark.createDataFrame(rows + odd + rows[:2], "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "2 AS bucket")
    want = full_search(rows, 20)
    got = defaultdict(list)
    for r in neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    for q, (best,) in want.items():
        assert [v for v, _ in got[q]] == [v for v, _ in best]
        assert np.allclose([s for _, s in got[q]], [s for _, s in best], rtol=1e-12)
    assert neighbours.nearest(vectors.limit(0), F.lit(True)).count() == 0


def test_op7_recall(spark, sf_dir):
    raw = pd.read_parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    x, ids = np.array(raw.embedding.tolist(), float), raw.vec_id.to_numpy()
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, meet=20).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(g.vec_id))
    assert hits >= 0.9 * 20 * sum(i % 20 == 0 for i in ids.tolist())


def recall_of(got, x, k=20):
    """The share of the exact ``k`` best that was found, and the least number of rows of a query; vec_id is the row of ``x``."""
    hits, least = 0, k
    for q, g in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:k].tolist()) & set(g.vec_id))
        least = min(least, len(g))
    return hits / (k * got.query_id.nunique()), least


def test_unequal_norms_keep_the_recall(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(6000, 32)) / np.sqrt(32)
    x *= np.exp(0.5 * rnd.normal(size=6000))[:, None]
    x[77] *= 10
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors, F.col("vec_id") % 40 == 0, meet=20).toPandas()
    recall, least = recall_of(got, x)
    assert recall >= 0.85 and least == 20 and got.query_id.nunique() == 150


def test_queries_that_meet_too_few_are_searched_whole(spark):
    x = np.random.default_rng(4).normal(size=(1500, 32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors, F.col("vec_id") % 50 == 0, tables=1, probes=1, meet=0).toPandas()
    recall, least = recall_of(got, x)
    assert least == 20 and got.query_id.nunique() == 30
    assert sorted(got["rank"]) == sorted(list(range(1, 21)) * 30)


def test_a_stray_dimension_changes_no_other_search(spark):
    x = np.random.default_rng(5).normal(size=(2000, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    search = lambda r: neighbours.nearest(spark.createDataFrame(r, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, tables=2, probes=4, meet=20)
    plain, stray = search(rows).toPandas(), search([*rows, (2001, [1.0, 2.0])]).toPandas()
    order = ["query_id", "rank"]
    assert plain.sort_values(order).reset_index(drop=True).equals(stray.sort_values(order).reset_index(drop=True))
    assert recall_of(plain, x)[0] < 1


def test_few_vectors_are_hashed_like_many(spark):
    x = np.random.default_rng(6).normal(size=(900, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    far = np.random.default_rng(7).normal(size=(8000, 64))
    far *= 0.99 / np.sqrt((far * far).sum(1))[:, None]
    search = lambda v: neighbours.nearest(
        spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(v)], "vec_id long, embedding array<double>"), (F.col("vec_id") % 100 == 0) & (F.col("vec_id") < 900), tables=2, probes=12
    ).toPandas()
    few, many = search(x), search(np.concatenate([x, far]))
    score = {(q, v): s for q, v, s in zip(few.query_id, few.vec_id, few.score, strict=True)}
    least = many.groupby("query_id").score.min()
    old = many[many.vec_id < 900]
    assert len(old) and all((q, v) in score for q, v in zip(old.query_id, old.vec_id, strict=True))
    kept = {(q, v) for q, v in zip(old.query_id, old.vec_id, strict=True)}
    assert all(k in kept for k, s in score.items() if s > least[k[0]])
    assert 0 < recall_of(few, x)[0] < 1


def test_recall_on_few_vectors(spark):
    for n, d in ((500, 64), (2000, 64)):
        x = np.random.default_rng(n).normal(size=(n, d))
        x /= np.sqrt((x * x).sum(1))[:, None]
        vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        recall, least = recall_of(neighbours.nearest(vectors, F.col("vec_id") % 20 == 0).toPandas(), x)
        assert recall >= 0.9 and least == 20


def test_shared_phrases_and_copies_keep_their_text(spark):
    rnd = random.Random(8)
    own = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(10**6)) for _ in range(n))
    menu, phrase, story = "all about the shop and its owners", "as far as we know by now", own(60)
    texts = [f"{own(20)} {phrase} {own(20)}" if i in (3, 30) else own(40) for i in range(40)]
    texts += [story, story, f"{own(5)} {story[: story.rindex(' ')]}"]  # equal pages, and one that holds nearly all of them
    rows = [(i, "http://h/", f"<div>{menu}</div><p>{t}</p>") for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.main_text(pages).collect()}
    assert [got[i] for i in range(40)] == texts[:40]
    whole, part = [story, texts[42]], [story.split()[-1], " ".join(texts[42].split()[:5])]
    assert got[40] == got[41] and [got[40], got[42]] in ([whole[0], part[1]], [part[0], whole[1]])


def test_marked_articles_are_no_main_text():
    page = """<article class="post tag-ads category-social has-sidebar">a<article class="comment-body">c</article><section id="x"><article role=comment>d</article>b</section></article>
<article class="related">r<article>s</article></article><article class="comments"><article>t</article></article>"""
    assert main_text.page_blocks(page) == [(0, "a"), (2, "c"), (2, "d"), (0, "b"), (2, "r"), (2, "s"), (2, "t")]
