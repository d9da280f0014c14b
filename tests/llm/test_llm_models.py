"""Classifiers on held-out labels, search against brute force, and page extraction."""

import pickle
from collections import Counter

import duckdb
import numpy as np
import pytest

from tracewell.llm import html_extract, labelled, quality, topk, toxicity
from tracewell.llm.queries import QUERIES, SQL


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op9_quality", "quality", 0.97), ("op3_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(name, label, least, spark):
    sf_dir = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert auc(held.score.to_numpy(), held[label].to_numpy()) > least


@pytest.mark.parametrize("f", [quality.quality, toxicity.toxicity])
def test_classifiers_without_labels_and_with_odd_rows(f, spark):
    docs = spark.createDataFrame([(1, "a", 0.5), (2, None, 0.5), (2, "", 0.5), (None, "x" * 100_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = f(spark, docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got) and len({round(r["score"], 6) for r in got}) == 1
    assert f(spark, docs.limit(0), labels.limit(0)).count() == 0


def test_counterfactuals_keep_weight_off_mentions():
    rng = np.random.default_rng(0)
    filler = [f"w{i}" for i in range(200)]
    texts, y = [], []
    for i in range(600):
        words = list(rng.choice(filler, 20))
        toxic = i % 3 == 0
        if toxic:
            words.append("awful")
            if i % 2:
                words.append("muslim")  # named more often in toxic texts
        elif i % 40 == 0:
            words.append("muslim")
        texts.append(" ".join(words))
        y.append(int(toxic))
    y, w = np.array(y), np.ones(len(y))
    changes = [c for t in texts for c in toxicity.swaps(t)]
    fair, plain = (toxicity.ToxicityModel(*pickle.loads(toxicity.train([toxicity.words(t) for t in texts], y, w, changes, penalty=p))) for p in (5.0, 0.0))
    gap = lambda m: abs(m.score(["w1 w2 muslim"])[0] - m.score(["w1 w2 jewish"])[0])
    assert gap(fair) < gap(plain) and fair.score(["w1 w2 muslim"])[0] < 0.5 < fair.score(["w1 w2 awful"])[0]


def test_swaps_of_unknown_words_change_nothing():
    texts, y = ["good words here"] * 9 + ["awful words here"] * 9 + ["a muslim spoke"], np.array([0] * 9 + [1] * 9 + [0])
    changes = [c for t in texts for c in toxicity.swaps(t)]
    trained = [pickle.loads(toxicity.train([toxicity.words(t) for t in texts], y, np.ones(len(y)), c)) for c in (changes, [])]
    assert changes and trained[0] == trained[1]


def test_swaps_are_of_sentences():
    assert toxicity.swaps(None) == [] == toxicity.swaps("No group here. None there.")
    got = toxicity.swaps("The black cat. Women and men spoke! Other words.\nA blind man")
    gone = [set(a.split()) for a, _ in got]
    assert {"black", "blac*"} in gone and not any("cat" in g or "other" in g for g in gone) and len(got) >= 4


@pytest.mark.parametrize("f", [quality, toxicity])
def test_conflicting_labels_teach_nothing_and_long_texts_are_read_whole(f, spark):
    rng = np.random.default_rng(6)
    say = lambda bad, n: " ".join(rng.choice(["zzx", "qqj", "xxk"] if bad else ["plain", "words", "here", "are"], n))
    rows = [(i, say(i % 2, 60)) for i in range(400)] + [(1000, say(0, 40_000) + " " + say(1, 40_000)), (1001, say(0, 200_000)), (1002, None)]
    labels = [(i, i % 2, i % 2) for i in range(300)] + [(i, 1 - i % 2, 1 - i % 2) for i in range(0, 300, 10)] + [(i, i % 2, i % 2) for i in range(0, 300, 10)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    run = f.quality if f is quality else f.toxicity
    one, two = ({r["doc_id"]: r["score"] for r in run(spark, d, labels).collect()} for d in (docs, docs.repartition(7)))
    assert one.keys() == two.keys() == {r[0] for r in rows} and all(abs(one[i] - two[i]) < 1e-9 for i in one)
    assert all((one[i] > 0.5) == (i % 2 == 1) for i in range(300, 400)) and one[1001] < 0.5
    if f is toxicity:
        assert one[1000] > 10 * one[1001]  # what lies at the end of a long text counts
    taught, _ = labelled.sample(docs, labels, "toxic", labelled.remainder("doc_id", 5) >= 0, 500)
    assert {r["doc_id"] for r in taught.collect()} == {i for i in range(300) if i % 10}


def test_newton_recovers_coefficients():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 2))
    y = (rng.random(5000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(int)
    assert labelled.newton_logistic(x, y, np.ones(5000)) == pytest.approx([0.5, 2, -1], abs=0.25)


def brute_top(rows, k, every):
    good = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in good if i % every == 0}:
        hits = sorted((-int(np.dot(q, v)), j) for j, v in good if j != i and len(v) == len(q))[:k]
        out |= {(i, n, j, -s) for n, (s, j) in enumerate(hits, 1)}
    return out


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 150)
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "LEAF", 16)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, [0.5] * 3), (2081, [0.25] * 3), (None, [0.1] * 8), (2100, [])]
    df = spark.createDataFrame([(i, v, "r") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = {tuple(r) for r in topk.top_k(spark, df, 20, 20).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows, 20, 20)
    assert topk.top_k(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [40, 2**27])
def test_ball_tree_bounds_hold(scale):
    rng = np.random.default_rng(3)
    dim = 6 if scale == 40 else 64
    x = rng.integers(-scale, scale, (1000, dim))
    tree = topk.BallTree(np.arange(1000), x)
    q = rng.integers(-scale, scale, (200, dim))
    if dim == 64:  # nearly orthogonal to the centres: large terms cancel
        c = tree.centres[0]
        q = (q - np.outer(q @ c / (c @ c), c)).astype(np.int64)
    up = tree.bounds(q[:40], list(range(tree.first, 2 * tree.first + 1)))
    for n, (_, leaf) in enumerate(tree.leaves):
        best = max_products(q, leaf)
        assert all(int(b) <= u for b, u in zip(best, up[:, n], strict=True))


def max_products(q, x):
    return [max(sum(int(a) * int(b) for a, b in zip(i, j, strict=True)) for j in x[:20]) for i in q[:40]]


def test_inner_nodes_are_pruned_and_cells_are_even(monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 32)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 3, (500, 5)) for c in ([90, 0, 0, 0, 0], [0, 90, 0, 0, 0], [-90, 0, 0, 0, 0], [0, 0, -90, 0, 0])]).astype(np.int64)
    tree, visited = topk.BallTree(np.arange(2000), x), []
    q = np.array([[80, 0, 0, 0, 0], [0, 0, -80, 0, 0]])
    owner, score, ids = topk.search(tree, np.array([-1, -2]), q, np.full(2, -np.inf), 20, visited)
    for i in range(2):
        want = sorted((-int(s), j) for j, s in enumerate(x @ q[i]))[:20]
        assert sorted(zip((-score[owner == i]).tolist(), ids[owner == i].tolist(), strict=True)) == want
    assert sum(n for _, n in visited) <= 40 < 2 * len(tree.leaves)  # pairs of leaf and query
    cells = topk.Cells(x, 16)
    assert np.bincount(cells.of(x)).max() < 400 and len(np.unique(topk.Cells(np.ones((200, 3)), 4).of(np.ones((50, 3))))) == 1


def test_top_k_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    want = {tuple(map(int, r)) for r in con.sql(SQL["op2_ball_tree_topk"]).fetchall()}
    assert {tuple(r) for r in QUERIES["op2_ball_tree_topk"](spark, sf_dir).collect()} == want


PAGES = {
    None: "", "": "", "<html></html>": "", "just text": "just text", "<p>One.<p>Two &amp; three&nbsp;four": "One.\nTwo & three four",
    "<article><h1>T</h1><p>a<br>b</p><div class='ad'>Buy</div><p>c <b>d</b>e</p></article>": "T\na b\nc de",
    "<nav><a href=x>Home</a></nav><main><p>Body text.</p><aside>Side</aside></main><footer>&copy; x</footer>": "Body text.",
    "<p>A</p><script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>B</p>": "A\nB",
    "<article><p>Text</p><section id='comments'><p>Reader</p></section><form><p>Name</p></form></article>": "Text",
    "<div class='cookie-notice'>We use cookies</div><div class='entry-content'><p>Story.</p></div>": "Story.",
    "<header><p>Site</p></header><article><header><h1>Head</h1></header><p>Text.</p></article>": "Head\nText.",
    "<p>open <a href='x>": "open", "<article><p>x &lt;b&gt; &#233; &am</p></article>": "x <b> é &am",
    "<ul class=menu><li>One</li></ul><article><ul><li>p</li><li>q</li></ul></article>": "p\nq",
}


def test_main_text(spark):
    assert {h: html_extract.main_text(h) for h in PAGES} == PAGES
    df = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(spark, df).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(PAGES.values())}
    assert html_extract.extract(spark, df.limit(0)).count() == 0


ARTICLE = "<h1>What it is about</h1>" + "".join(f"<p>This is the {n} part of the text and it is as long as it has to be for what is in it.</p>" for n in ("first", "second", "third"))
LINES = html_extract.main_text(f"<article>{ARTICLE}</article>")


@pytest.mark.parametrize("page", [
    f"<div class='content has-sidebar'><article>{ARTICLE}</article></div>", f"<div class='no-sidebar'><main>{ARTICLE}</main></div>", f"<div class='page search-page'>{ARTICLE}</div>",
    f"<div id='legal-news'><article>{ARTICLE}</article></div>", f"<form id='aspnetForm'><div>{ARTICLE}</div></form>", f"<form><div class='widget-area'><div id='sidebar-wrap'>{ARTICLE}</div></div></form>",
    f"<div class='search'><div class='sidebar'><a href='x'>More</a> like this</div><main>{ARTICLE}</main></div>", f"<article>{ARTICLE}</article><div class='comments'>{'<p>I say what I think of it and more of that.</p>' * 30}</div>",
    f"<div class='cookie-notice'>{'<p>We use what you give us and more of that.</p>' * 30}</div><article>{ARTICLE}</article>", f"<article>{ARTICLE}<span class='ad'>Buy</span></article>",
])
def test_layouts_leave_the_article(page):
    assert html_extract.main_text(page) == LINES and LINES.count("\n") == 3


def test_spans_in_paragraphs_are_text():
    assert html_extract.main_text("<article><p>See <span class='comment'>the remark</span> here</p></article>") == "See the remark here"


def test_labelled_pages_by_word_overlap():
    rng = np.random.default_rng(5)
    stop = "the of and to in is that it was for on are as with be by at this from".split()
    say = lambda n: " ".join(rng.choice(stop) if rng.random() < 0.45 else "".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)).capitalize() + "."
    around = [
        "<nav><ul>{l}</ul></nav><main>{a}</main><aside>{s}</aside><footer>{s}</footer>", "<div id=header><ul>{l}</ul></div><div class='post-content'>{a}</div><div class='related-posts'>{l}</div>",
        "<form id=f><div class='menu'>{l}</div><div class=wrap>{a}</div><div id=footer>{s}</div></form>", "<div class='layout has-sidebar'><div class='sidebar'>{s}</div><div class='story'>{a}</div></div><div id='comments'>{c}</div>",
        "<table><tr><td>{l}</td><td>{a}</td></tr></table><p>© 2020 {s}</p>", "<div>{l}</div>{a}<div>{l}</div>",
    ]
    scores = []
    for page in range(60):
        paragraphs = [say(int(rng.integers(25, 90))) for _ in range(rng.integers(2, 8))]
        parts = {"a": "".join(f"<p>{x}</p>" for x in paragraphs), "l": "".join(f"<li><a href='/{k}'>{say(3)}</a></li>" for k in range(6)), "s": f"<p>{say(6)}</p>", "c": "".join(f"<p>{say(20)}</p>" for _ in range(12))}
        got, want = html_extract.main_text(around[page % len(around)].format(**parts)).split(), " ".join(paragraphs).split()
        both = sum((Counter(got) & Counter(want)).values())
        scores.append(2 * both / (len(got) + len(want)))
    assert np.mean(scores) > 0.97 and min(scores) > 0.8


def test_densities_decide_without_containers():
    text = "This is the first part of the text and it is as long as it has to be for the rules to see that it is what the page is about, with more of the words that are in it and so on."
    page = f"<div><a href=1>Home</a> <a href=2>News about things</a> <a href=3>More</a></div><p>{text} {text}</p><p>Short but near.</p><p>{text} {text}</p><div><a href=4>Next page of the list</a></div><div>© 2020 Somebody</div>"
    assert html_extract.main_text(page) == f"{text} {text}\nShort but near.\n{text} {text}"


@pytest.mark.parametrize("page", ["<div " * 50_000, '<a x="' * 30_000, "<!-- " * 30_000, "<script>" * 3000 + "x" * 50_000, "<b>" * 50_000 + "x", "&" * 100_000])
def test_odd_pages_take_no_time(page):
    html_extract.main_text(page)
