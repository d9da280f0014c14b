"""Source divergence, prefix forest and prefix trie against brute force on small tables with odd rows."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import common, divergence, prefix_forest, prefix_trie, queries

DOCS = "doc_id long, text string, lang string, source string, term string, n long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def divergence_of(rows, least, top):
    terms = [(lang or "", source or "", [t.translate({k: k + 32 for k in range(65, 91)}) for t in TERM.findall(text or "")]) for _, text, lang, source, *_ in rows]
    df, total, of, groups = Counter(), Counter(), Counter(), defaultdict(set)
    for lang, source, own in terms:
        groups[lang].add(source)
        df.update((lang, t) for t in set(own))
        total.update((lang, t) for t in own)
        of.update((lang, source, t) for t in own)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (g, t), n in df.items() if g == lang and n >= least)
        v, lang_n = len(kept), sum(total[lang, t] for t in kept)
        q = {t: 1 + 10**9 * (total[lang, t] + 2) // (lang_n + 2 * v) for t in kept}
        p = {s: {t: 1 + 10**9 * (of[lang, s, t] + 2) // (sum(of[lang, s, x] for x in kept) + 2 * v) for t in kept} for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms_ = [(-f(p[s][t], q[t]), t.encode()) for t in kept if of[lang, s, t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms_)[:top])):
                out |= {(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


def some_documents():
    r = np.random.default_rng(5)
    words = ["The", "the,", "the", "ÄB", "äb", "x-y", "X_y", "日本", "a b", "don't", "12", "...", "(zoo)", "é́", "naïve", "Zoo.", "q\x1cz", "　s", "low", "LOW"]
    rows = [(int(i), " ".join(r.choice(words, r.integers(0, 40))), str(r.choice(["en", "de", ""])), str(r.choice(["s0", "s0", "s1", "s2"])), "t", 1) for i in range(150)]
    rows += [(None, "the the zoo", "en", None, None, None), (1, None, None, None, None, None), (1, "", "only", "one", "", 0), (2, "12 ...", "mute", "a", "", 0), (3, " \t", "mute", "b", "", 0)]
    return rows + [(4, "w" * 300_000 + " " + "the " * 50_000, "en", "s1", "", 0), (5, "the", "en", "s2", "", 0), (5, "the", "en", "s2", "", 0)]


@pytest.mark.parametrize("sources", [64, 1])
def test_divergence_equals_brute_force(spark, monkeypatch, sources):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    rows = some_documents()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for least in (2, 10):
        got = [tuple(r) for r in divergence.divergence(spark, df, least, 10).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == divergence_of(rows, least, 10)


def test_divergence_of_nothing_and_of_many_blocks(spark, monkeypatch):
    assert divergence.divergence(spark, spark.createDataFrame([], DOCS)).count() == 0
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 200)
    rows = some_documents()[:-3]
    batches = [b for b in spark.createDataFrame([(x[2] or "", x[3] or "", (x[1] or "").encode()) for x in rows], "lang string, source string, text binary").toArrow().to_batches()]

    class Here:
        def partitionId(self):
            return 0

    monkeypatch.setattr(divergence.TaskContext, "get", Here)
    found = [r for b in divergence._blocks(iter(batches), 7) for r in b.to_pylist()]
    assert len({r["block"] for r in found}) > 5
    assert sum(len(r["sizes"]) // 4 for r in found if r["kind"] == 0) == len(rows)


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 10**10, 5 * 10**17])
    assert divergence.shares(counts, 10**18, 3).tolist() == [1 + 10**9 * (int(c) + 2) // (10**18 + 6) for c in counts]


def vectors(n, dim=16, seed=0):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, dim)) * r.uniform(0.5, 1, size=(n, 1))


VECS = "vec_id long, embedding array<double>, score double, rank string"


def nearest(rows, k=20, every=20):
    fine = [(i, np.array(v)) for i, v, *_ in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in {(i, tuple(v)) for i, v in fine if i % every == 0}:
        near = sorted((-float(np.array(v) @ w), j) for j, w in fine if j != i and len(w) == len(v))[:k]
        out.setdefault(i, []).append([(j, -s) for s, j in near])
    return out


def test_small_forests_find_all(spark):
    rows = [(i, v.tolist(), 0.0, "") for i, v in enumerate(vectors(120))]
    rows += [(200, rows[0][1], 0.0, ""), (201, rows[0][1], 0.0, ""), (20, rows[20][1], 0.0, ""), (20, rows[3][1], 0.0, "")]
    rows += [(None, rows[1][1], 0.0, ""), (240, None, 0.0, ""), (260, [0.0] * 16, 0.0, ""), (280, [float("nan")] * 16, 0.0, ""), (300, [None] * 16, 0.0, ""), (320, [1.0, 2.0], 0.0, ""), (321, [3.0, 1.0], 0.0, ""), (340, [], 0.0, "")]
    rows += [(1000 + i, rows[5][1], 0.0, "") for i in range(60)]  # a vector that many rows repeat, queries too
    got = {}
    for r in prefix_forest.neighbours(spark, spark.createDataFrame(rows, VECS).repartition(3)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    want = nearest(rows)
    assert got.keys() == want.keys()
    for q, lists in want.items():
        assert len(got[q]) == sum(map(len, lists))
        if len(lists) == 1:
            assert [x[0] for x in got[q]] == [x[0] for x in lists[0]] and [x[2] for x in got[q]] == list(range(1, len(lists[0]) + 1))
            assert np.allclose([x[1] for x in got[q]], [x[1] for x in lists[0]], atol=1e-12)
    assert prefix_forest.neighbours(spark, spark.createDataFrame([], VECS)).count() == 0


@pytest.mark.parametrize("norms", [False, True])
def test_recall_of_isotropic_vectors(spark, monkeypatch, norms):
    """Random directions are the hardest case; segments of several digits, parts and blocks of queries give the same."""
    x = vectors(6000, 32, 3)
    x = x if norms else x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), 0.0, "") for i, v in enumerate(x)], VECS)
    want = nearest([(i, v) for i, v in enumerate(x)]) if not norms else None
    found = []
    for small in (False, True):
        if small:
            monkeypatch.setattr(prefix_forest, "SEGMENT", 100)
            monkeypatch.setattr(prefix_forest, "QUERIES", 7)
            assert prefix_forest.Plan(6000, 1.0).segment == 2
        got = {(r["query_id"], r["vec_id"]): r["score"] for r in prefix_forest.neighbours(spark, df).collect()}
        assert len(got) == 300 * 20
        for (q, v), s in list(got.items())[::50]:
            assert abs(x[q] @ x[v] - s) < 1e-12
        found.append(got)
    assert found[0] == found[1]
    scores = x[::20] @ x.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -9e9
    want = {(20 * q, int(v)) for q, own in enumerate(np.argsort(-scores, axis=1)[:, :20]) for v in own}
    assert len(want & found[0].keys()) >= 0.9 * len(want)


def test_forests_of_blocks_write_vectors_once(spark, monkeypatch, tmp_path):
    """Blocks, rounds and groups of queries change nothing; what is written doesn't grow with the number of trees."""
    x = vectors(3000, 64, 5).astype(np.float32)
    x[1500:1520] = x[1] * np.float32(1.01) + np.float32(1e-4) * x[2000:2020]  # close neighbours: deep intervals
    df = spark.createDataFrame([(i, v.tolist(), 0.0, "") for i, v in enumerate(x.astype(float))], VECS)
    written, mapped = [], common.mapped

    def measured(*args, **kwargs):
        out = mapped(*args, **kwargs)
        written.append(sum(os.path.getsize(f.removeprefix("file:")) for f in out.inputFiles()))
        return out

    for module in (common, prefix_forest):
        monkeypatch.setattr(module, "mapped", measured)
    found = []
    for block in (None, 250):
        if block:
            monkeypatch.setattr(prefix_forest, "BLOCK", block)
            plan = prefix_forest.Plan(3000, 1.0, 64, 4)
            assert (plan.blocks, plan.first) == (12, 4)
        found.append({(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in prefix_forest.neighbours(spark, df).collect()})
        assert sum(written) < 6 * x.nbytes  # the vectors once, then queries, keys and results
        written.clear()
    assert len(found[0]) == 150 * 20 and found[0] == found[1]


TURNS = "conv_id long, turn long, role string, text string, depth long"


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = Counter(), Counter()
    for node, own_ in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own_) - 1) * words
            leaves[node[:d]] += not children[node]
    out = set()
    for node, own_ in members.items():
        ends = ",".join(str(c) for c in sorted(own_) if len(whole[c]) == len(node))
        out.add((min(own_), len(node), min(members[node[:-1]]) if node else None, len(own_), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_conversations():
    r = np.random.default_rng(2)
    rows = []
    for c in [*range(-25, 90), 10**12, 10**12 + 3, 10**12 + 7]:
        shared = int(r.integers(0, 6))
        for t in range(int(r.integers(1, 9))):
            text = f"same {t} words" if t < shared else f"own {r.integers(0, 3)} of {t}"
            rows.append((c, t, "user" if t % 2 else "assistant", text, 7))
    rows += [(200, t, "u", f"deep {t} {t % 3}", 0) for t in range(700)] + [(201, t, "u", f"deep {t} {t % 3}" if t < 400 else "other", 0) for t in range(500)]
    rows += [(202, None, None, None, None), (202, None, "a", "", None), (202, 1, "b", "x", None), (202, 1, "a", "x", None), (202, 1, "a", "x", None), (None, 1, "a", "x", 1), (203, 1, "", None, 0), (204, 1, "u", "a b " * 50_000, 0)]
    return rows + [(c, 0, "s", "hot", 0) for c in range(1000, 1400)]


def test_trie_equals_brute_force(spark, monkeypatch):
    rows = some_conversations()
    want = trie(rows)
    df = spark.createDataFrame(rows, TURNS)
    for height, piece, partitions in ((16, 1 << 20, 4), (2, 100, 13)):
        monkeypatch.setattr(prefix_trie, "HEIGHT", height)
        monkeypatch.setattr(prefix_trie, "PIECE", piece)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = [tuple(r) for r in prefix_trie.prefix_trie(spark, df.repartition(5)).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert len(got) == len(want) and set(got) == want
    assert prefix_trie.prefix_trie(spark, spark.createDataFrame([], TURNS)).count() == 0


def test_new_queries_are_registered():
    assert {"op11_source_divergence", "op12_prefix_forest", "op13_prefix_trie"} <= queries.QUERIES.keys()
    assert {"op11_source_divergence", "op13_prefix_trie"} <= queries.SQL.keys()


def mentions(seed, n=1200):
    """Sentences that name groups, toxic or neutral; some groups are named more often in toxic ones, as in real labels."""
    from tracewell.llm import toxicity

    r = np.random.default_rng(seed)
    filler, bad = [f"w{i}" for i in range(150)], ["awful", "stupid", "vermin"]
    often = [row[0] for row in toxicity.IDENTITY_TERMS]
    texts, y, named = [], [], []
    for i in range(n):
        row = toxicity.IDENTITY_TERMS[int(r.integers(len(toxicity.IDENTITY_TERMS)))]
        toxic = i % 3 == 0
        term = (row[0] if r.random() < 0.85 else str(r.choice(row[1:]))) if toxic else (str(r.choice(row[1:])) if r.random() < 0.9 else row[0])
        has = toxic or i % 3 == 1
        own = [*r.choice(filler, 12), *([str(r.choice(bad))] if toxic and r.random() < 0.7 else []), *([term] if has else [])]
        texts.append(" ".join(r.permutation(own)))
        y.append(int(toxic))
        named.append(has and not toxic and term in often)
    return texts, np.array(y), np.array(named)


def test_penalty_lowers_false_positives_on_neutral_mentions():
    """Of neutral sentences that name a group which toxic ones name often, fewer are marked; toxic ones are still found."""
    import pickle

    from tracewell.llm import toxicity

    texts, y, _ = mentions(1)
    new, new_y, neutral = mentions(2)
    changes = [c for t in texts for c in toxicity.swaps(t)]
    marked = {}
    for penalty in (5.0, 0.0):
        model = toxicity.ToxicityModel(*pickle.loads(toxicity.train([toxicity.words(t) for t in texts], y, np.ones(len(y)), changes, penalty=penalty)))
        said = model.score(new) >= 0.5
        insults = np.array([any(w in t for w in ("awful", "stupid", "vermin")) for t in new])
        marked[penalty] = said[neutral].mean(), said[(new_y == 1) & insults].mean()
    assert neutral.sum() > 30 and marked[0.0][0] >= 0.4 and marked[5.0][0] <= 0.15, marked
    assert marked[5.0][1] >= 0.9, marked


def test_every_other_term_of_a_kind_is_tried():
    from tracewell.llm import toxicity

    for row in toxicity.IDENTITY_TERMS:
        come = {b.split(" ")[0] for _, b in toxicity.swaps(f"about {row[0]} here") for b in [min(b.split(" "), key=lambda f: ("*" in f, f))]}
        assert come == set(row[1:])


def paragraphs_of(texts):
    """(set of 5-grams, buckets, kind) of every different paragraph, and the documents that have it."""
    from tracewell.llm import substring_dedup as s
    from tracewell.llm.shingles import shingle_hashes, word_hashes, words_of

    found, docs = {}, defaultdict(set)
    for d, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        offsets = np.array([0, len(raw)])
        _, first, last, k1, _, bands = s.cut_paragraphs(raw, offsets)
        start, end, at = words_of(raw, offsets)
        hashes = word_hashes(raw, start, end)
        for a, b, k, own in zip(first, last, k1, bands, strict=True):
            docs[k].add(d)
            grams, _ = shingle_hashes(hashes[a:b], np.array([0, b - a]))
            found[k] = set(grams.tolist()), set(own.tolist()), "placed" if b - a == s.LEAST else "line"
    return found, docs


def test_bands_find_similar_paragraphs_of_both_kinds(sf_dir):
    """Recall of the banding against all pairs of different paragraphs with a similarity of 0.8 or more, across documents."""
    import pyarrow.parquet as pq

    r = np.random.default_rng(8)
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    words = [f"t{i}" for i in range(500)]
    for k in range(120):  # a line, and a longer line that holds it with a changed first or last word
        line = list(r.choice(words, 24 + k % 3))
        other_ = [*line]
        other_[0 if k % 2 else -1] = "changed"
        texts += [" ".join(line), " ".join([*r.choice(words, 40), *other_, *r.choice(words, 40)])]
    found, docs = paragraphs_of(texts)
    by_gram = defaultdict(list)
    for k, (grams, _, _) in found.items():
        for g in grams:
            by_gram[g].append(k)
    shared = Counter()
    for ks in by_gram.values():
        shared.update((min(a, b), max(a, b)) for i, a in enumerate(ks) for b in ks[i + 1 :])
    hit, all_ = Counter(), Counter()
    for (a, b), n in shared.items():
        (x, p, s), (y, q, t) = found[a], found[b]
        if n >= 0.8 * (len(x) + len(y) - n) and len(docs[a] | docs[b]) > 1:
            kind = "-".join(sorted((s, t)))
            all_[kind] += 1
            hit[kind] += bool(p & q)
    assert {"line-placed", "placed-placed"} <= all_.keys() and all(hit[k] >= 0.9 * n for k, n in all_.items() if n >= 10), (hit, all_)


def test_passages_with_a_changed_word_are_found(spark):
    """60 words inside longer lines, one of them changed in the second document: most of these pairs lose words there, and nothing else goes."""
    from tracewell.llm import substring_dedup

    r = np.random.default_rng(9)
    words, rows = [f"t{i}" for i in range(3000)], []
    for k in range(40):
        passage = list(r.choice(words, 60))
        changed = [*passage]
        changed[30] = "changed"
        rows += [(2 * k, " ".join([*r.choice(words, 30), *own, *r.choice(words, 30)]), "", "") if own is passage else (2 * k + 1, " ".join([*r.choice(words, 30), *own, *r.choice(words, 30)]), "", "") for own in (passage, changed)]
    got = {x["doc_id"]: x for x in substring_dedup.substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    touched = [got[2 * k + 1]["removed_words"] for k in range(40)]
    assert all(got[2 * k]["removed_words"] == 0 for k in range(40)) and max(touched) <= 60
    assert sum(n > 0 for n in touched) >= 0.7 * 40 and np.mean(touched) >= 20, (sum(n > 0 for n in touched), np.mean(touched))


#: Running text in languages with and without a list of stop words.
SENTENCES = {
    "en": "The committee said on Monday that it would look again at the plan for the river and the old bridge.",
    "de": "Der Ausschuss sagte am Montag, dass er sich den Plan für den Fluss und die alte Brücke noch einmal ansehen werde.",
    "it": "Il comitato ha detto lunedì che esaminerà di nuovo il progetto per il fiume e per il vecchio ponte della città.",
    "pt": "A comissão disse na segunda-feira que vai analisar de novo o plano para o rio e para a velha ponte da cidade.",
    "ru": "Комитет сообщил в понедельник, что снова рассмотрит план для реки и старого моста в центре города.",
    "pl": "Komitet powiedział w poniedziałek, że jeszcze raz przyjrzy się planowi dla rzeki i starego mostu w mieście.",
    "tr": "Kurul pazartesi günü nehir ve eski köprü için hazırlanan planı yeniden ele alacağını söyledi.",
    "ja": "委員会は月曜日に、川と古い橋の計画をもう一度見直すと発表しました。市民からは多くの意見が寄せられています。",
    "zh": "委员会星期一表示，将重新审查河流和旧桥的规划。许多市民已经提出了自己的意见和建议。",
    "hi": "समिति ने सोमवार को कहा कि वह नदी और पुराने पुल की योजना पर फिर से विचार करेगी।",
}
LAYOUTS = (
    "<body><nav><ul>{links}</ul></nav><div>{body}</div><footer>{foot}</footer></body>",
    "<body><div class='menu'>{links}</div><article>{body}</article><aside>{links}</aside><div class='comments'>{foot}</div></body>",
    "<body><form><fieldset><div>{body}</div></fieldset></form><div class=footer>{links} {foot}</div></body>",
    "<body><header>{links}</header><main>{body}</main><script>var a = '{foot}';</script></body>",
    "<body><dialog open><div>{body}</div></dialog><ul class='nav'>{links}</ul></body>",
    "<body><div aria-hidden='true'>{body}</div><div>{links}</div></body>",
    "<body><article>{body}</article><div>{more}</div><div class='related'>{links}</div></body>",
)


@pytest.mark.parametrize("lang", sorted(SENTENCES))
def test_main_text_in_every_layout(lang):
    from tracewell.llm import html_extract

    said = SENTENCES[lang]
    paragraphs = [f"{said} {said} {said}", f"{said} {said}", f"{said} {said} {said} {said}"]
    links = "".join(f"<li><a href='/{i}'>{said.split(' ')[0][:12]} {i}</a></li>" for i in range(6))
    body, more = ("".join(f"<p>{p}</p>" for p in own) for own in (paragraphs, paragraphs[:2]))
    for layout in LAYOUTS:
        got = html_extract.main_text(layout.format(links=links, body=body, more=more, foot="© 2020 Example"))
        assert got == "\n".join(paragraphs + (paragraphs[:2] if "{more}" in layout else [])), layout


def test_parts_of_an_article_stay_and_ends_cost_nothing():
    import time

    from tracewell.llm import html_extract

    p = SENTENCES["en"] * 3
    got = html_extract.main_text(f"<article><p>{p}</p><p><a href=1>Read what the committee has said about it.</a></p><p>So <math><mi>x</mi></math> holds, {p}</p></article>")
    assert "Read what the committee has said about it." in got and "So x holds" in got
    for page in ("<span class='ad'>" * 20_000 + "</div>" * 20_000, "<div class='ad'>" * 20_000 + "</span>" * 20_000 + "</div>" * 20_000):
        before = time.perf_counter()
        html_extract.main_text(page)
        assert time.perf_counter() - before < 5
