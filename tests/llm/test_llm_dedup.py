"""Exact, near and substring deduplication, and components, on small tables with every awkward case."""

import random
import re

import duckdb
import numpy as np
import pytest

from tracewell.llm import common, components, exact_dedup, mphf, ngram_join, shingles, substring_dedup
from tracewell.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, keep_id string, label int"  # with names that clash with results


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 7, 64, 65, 5000])
def test_minimal_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    h = mphf.MinimalPerfectHash.from_bytes(mphf.MinimalPerfectHash.build(keys).to_bytes())
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    others = h.slots(np.arange(1000, dtype=np.uint64))
    assert others.max(initial=-1) < max(1, len(keys))


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError, match="distinct"):
        mphf.MinimalPerfectHash.build(np.array([1, 1], np.uint64))


def test_exact_dedup_cases(spark):
    rows = [(5, "a b"), (3, "a\t\nb"), (9, None), (8, ""), (2, " "), (7, "a b"), (7, "a b"), (None, "a b"), (1, "A b"), (4, "x" * 100_000), (6, "x" * 100_000), (10, "a b")]
    got = {(r["doc_id"], r["kept"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(spark, docs(spark, rows)).collect()}
    assert got[(3, True)] == (3, 5) and got[(5, False)] == (3, 5) and got[(7, False)] == (3, 5) and got[(None, False)] == (3, 5)
    assert got[(8, True)] == (8, 2) and got[(9, False)] == (8, 2) and got[(2, True)] == (2, 1)
    assert got[(4, True)] == (4, 2) and got[(10, True)] == (10, 1) and got[(1, True)] == (1, 1)
    assert exact_dedup.exact_dedup(spark, docs(spark, rows).limit(0)).count() == 0


def test_exact_dedup_against_a_history(spark):
    old, new = docs(spark, [(1, "a"), (2, "b"), (3, "b")]), docs(spark, [(10, "b"), (11, "c"), (12, "c"), (13, "d")])
    index = exact_dedup.build_index(exact_dedup.keyed(old), 2)
    groups = {(r["keep_id"], r["group_size"]) for r in exact_dedup.groups_of(exact_dedup.keyed(new), index, 2).collect()}
    assert groups == {(1, 1), (2, 3), (11, 2), (13, 1)}


@pytest.mark.parametrize("at", [0, 3, 6])
def test_exact_dedup_with_null_and_large_ids(spark, at):
    rows = [(3, "a"), (4, "a"), (2**53 + 1, "b"), (2**53 + 3, "b"), (2**53 + 5, "c"), (2**63 - 1, "d")]
    for text, kept in (("a", False), ("b", False), ("e", True)):
        own = [*rows[:at], (None, text), *rows[at:]]
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", own)
        got = exact_dedup.exact_dedup(spark, docs(spark, own))
        want = con.sql(SQL["op1_exact_dedup"]).fetchall()
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
        left = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.keep_first(spark, docs(spark, own)).collect()), key=str)
        assert left == sorted([(3, "a"), (2**53 + 1, "b"), (2**53 + 5, "c"), (2**63 - 1, "d"), *([(None, text)] * kept)], key=str)


def test_one_row_of_each_text_stays_where_ids_repeat_or_are_null(spark):
    rows = [(3, "a"), (3, "a"), (3, "b"), (2, "b"), (None, "a"), (None, "c"), (None, "c"), (5, "d"), (5, "e"), (None, None), (None, "")]
    left = exact_dedup.keep_first(spark, docs(spark, rows))
    got = sorted(((r["doc_id"], r["text"] or "") for r in left.collect()), key=str)
    assert got == sorted([(3, "a"), (2, "b"), (None, "c"), (5, "d"), (5, "e"), (None, "")], key=str)


def test_kept_rows_have_all_columns(spark):
    left = exact_dedup.keep_first(spark, docs(spark, [(2, "a"), (1, "a"), (3, None), (4, "")]))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3] and left.columns == ["doc_id", "text", "keep_id", "label"]


def test_components_of_paths_stars_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = dict(components.components(spark.createDataFrame([*pairs, (None, 5)], "a long, b long")).collect())
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 160)} == {100} and {got[i] for i in (200, 201, 202)} == {200} and 300 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if i is not None and w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return {a: {b for b in sets if b != a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} for a in sets}


def test_ngram_join_against_brute_force(spark):
    rows = []
    for g in range(12):  # groups of near copies around each original, large enough for two blocks in one of them
        words = prose(g, 120).split()
        for k in range(40 if g else 300):
            w = list(words)
            r = random.Random(1000 * g + k)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"z{r.randrange(99)}"
            rows.append((len(rows) + 1, " ".join(w)))
    rows += [(2001, "one two"), (2002, "one  two"), (2003, "one three"), (2004, ""), (2005, None), (2006, " \n"), (2007, rows[0][1])]
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(spark, docs(spark, rows)).collect()}
    want = brute_links([r for r in rows if r[0] is not None])
    assert {i: got[i]["n_links"] for i in want} == {i: len(x) for i, x in want.items()}
    seen = {}
    for i in sorted(want):
        if i not in seen:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += want[x]
    assert {i: got[i]["class_id"] for i in want} == seen
    assert [(got[i]["class_id"], got[i]["n_links"], got[i]["kept"]) for i in (2004, 2005, 2006)] == [(i, 0, True) for i in (2004, 2005, 2006)]
    left = sorted(r["doc_id"] for r in ngram_join.keep_one_of_each(spark, docs(spark, rows)).collect())
    assert left == sorted(i for i in got if got[i]["kept"])


def test_one_row_of_each_class_stays_where_ids_repeat_or_are_null(spark):
    words = prose(77, 80).split()
    near = " ".join([*words[:79], "zz"])
    rows = [(3, " ".join(words)), (3, " ".join(words)), (None, near), (None, near), (3, "some other text of id three"), (5, near), (6, ""), (None, None), (None, prose(78, 30)), (None, prose(78, 30)), (2**53 + 1, prose(79, 9))]
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(spark, docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(3, 3, 4), (3, 3, 4), (None, 3, 4), (None, 3, 4), (3, 3, 0), (5, 3, 4), (6, 6, 0), (None, None, 0), (None, None, 1), (None, None, 1), (2**53 + 1, 2**53 + 1, 0)], key=str)
    left = ngram_join.keep_one_of_each(spark, docs(spark, rows))
    assert left.columns == ["doc_id", "text", "keep_id", "label"]
    want = [(3, " ".join(words)), (3, "some other text of id three"), (6, ""), (None, None), (None, prose(78, 30)), (2**53 + 1, prose(79, 9))]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(want, key=str)


def test_groups_tied_by_chains_of_buckets_meet_in_buckets_alone(spark):
    edges = [(b, i, 1) for b in range(50) for i in (b, b + 1)]  # a path: every bucket ties two
    dense = [(100 + b, 1000 + i, 1) for b in range(24) for i in range(8) if i != b]  # a group whose members meet again and again
    got = {r["id"]: [(g["group"], g["m"]) for g in r["own"]] for r in ngram_join.candidate_groups(ngram_join.shared_members(spark.createDataFrame([*edges, *dense, *dense], "bucket long, id long, n int"))).collect()}
    assert all(m == 2 for i in range(51) for _, m in got[i]) and {len(got[i]) for i in range(1, 50)} == {2}
    assert {tuple(got[1000 + i]) for i in range(8)} == {((1000, 8),)}


@pytest.mark.parametrize(("whole", "block", "small"), [(True, 7, 48), (False, 7, 48), (False, 512, 48), (False, 512, 3), (True, 512, 3)])
def test_links_count_once_however_groups_overlap(spark, whole, block, small, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*words[: 90 + i % 10], f"x{i}", f"y{i}"]) for i in range(40)]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    if not whole:  # judge every bucket
        chosen = ngram_join.candidate_groups

        def buckets(rows, whole):
            every = rows.groupBy("bucket").count().filter("count > 1").withColumnRenamed("count", "m")
            held = rows.join(every, "bucket").select("id", ngram_join.F.struct("bucket", "m", "m").cast(ngram_join._GROUP).alias("g")).groupBy("id").agg(ngram_join.F.collect_set("g").alias("own"))
            assert chosen(rows).count() == held.count()
            return held

        monkeypatch.setattr(ngram_join, "candidate_groups", buckets)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_join(spark, docs(spark, rows)).collect()}
    assert got == {i: len(x) for i, x in brute_links(rows).items()}


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(spark, docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_join(spark, docs(spark, [(1, "a b c")])).collect()] == [(1, 1, 0, True)]


def test_pruning_bound_is_the_posterior():
    least = ngram_join.least_matches((16, 96))
    assert least[0] < 16 * 0.8 and least[1] < 96 * 0.8
    rng = np.random.default_rng(0)  # pairs of similarity 0.8 must survive
    assert (rng.binomial(96, 0.8, 20_000) < least[1]).mean() < 1e-4


def test_shingles_across_slices_and_texts():
    texts = ["a b c d e f", "a b c d e f", "", "a b", "é x y", "  a b c d e  f \n", "b"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    start, end, first = shingles.words_of(raw, offsets)
    assert np.diff(first).tolist() == [6, 6, 0, 2, 2, 6, 1]
    sets = shingles.distinct(*shingles.shingle_hashes(shingles.word_hashes(raw, start, end), first))
    assert [len(s) for s in sets] == [2, 2, 0, 1, 1, 2, 1]
    assert (sets[0] == sets[1]).all() and (sets[0] == sets[5]).all() and sets[3] != sets[6]


def test_substring_dedup_cases(spark):
    passage, other = prose(1, 60), prose(2, 55)
    rows = [
        (1, f"{prose(10, 80)} {passage} {prose(11, 30)}"),
        (2, f"{prose(12, 33)} {passage} {prose(13, 64)}"),  # in the middle of a line
        (3, f"{prose(14, 40)}\n{passage}\n{prose(15, 20)}"),  # a line of its own
        (4, prose(16, 300)),
        (5, other), (6, other), (6, other),  # whole texts, repeated rows
        (7, ""), (8, None), (9, "short one"), (10, "short one"),
        (11, f"{prose(17, 30)}\n" + " ".join(["again and"] * 60)),  # repeats within one document alone
        (None, passage),
    ]
    near = prose(3, 90).split()
    rows += [(20, " ".join(near)), (21, " ".join([*near[:45], "zz", *near[46:]]))]  # near copies of a line
    df = docs(spark, rows)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark, df).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    for i in (2, 3):
        assert got[i]["class_id"] == 1 and got[i]["n_removed"] == 1 and passage not in got[i]["text"] and got[i]["removed_words"] >= 24
        (span,) = got[i]["spans"]
        text = rows[i - 1][1]
        assert got[i]["text"].split() == (text[: span["start"]] + " " + text[span["end"] :]).split()
    assert got[3]["text"] == f"{prose(14, 40)}\n{prose(15, 20)}" or got[3]["removed_words"] < 60
    assert got[6]["class_id"] == 5 and got[5]["text"] == other and len(got[6]["text"].split()) <= 55 - 24
    assert got[21]["class_id"] == 20 and got[21]["text"] == "" and got[20]["n_removed"] == 0
    for i in (4, 7, 9, 10, 11):
        assert (got[i]["class_id"], got[i]["n_removed"], got[i]["text"]) == (i, 0, dict(rows)[i])
    assert got[8]["text"] == "" and got[None]["text"] == passage and got[None]["class_id"] is None
    left = substring_dedup.without_repeats(spark, df)
    assert left.columns == ["doc_id", "text", "keep_id", "label"] and 21 not in {r["doc_id"] for r in left.collect()}
    assert substring_dedup.substring_dedup(spark, df.limit(0)).count() == 0


def test_no_long_run_stays_shared(spark, sf_dir):
    got = QUERIES["op8_substring_dedup"](spark, sf_dir).collect()
    seen = {}
    for r in got:
        w = r["text"].split()
        for k in range(len(w) - 50):
            assert seen.setdefault(tuple(w[k : k + 51]), r["doc_id"]) == r["doc_id"]
    source = {r["doc_id"]: r["text"] for r in common.table(spark, sf_dir, "documents").collect()}
    assert all(r["text"] == source[r["doc_id"]] for r in got if not r["n_removed"])


def test_exact_copies_of_lines_go_whole(spark):
    rows = []
    for n in (24, 27, 30, 36, 60):  # most of the shorter ones hold no placed paragraph that both documents share
        for k in range(4):
            line = prose(1000 + 10 * n + k, n)
            rows += [(len(rows) + 1 + j, f"{prose(5000 + 10 * len(rows) + j, 30)}\n{line}\n{prose(7000 + 10 * len(rows) + j, 30)}") for j in range(2)]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark, docs(spark, rows)).collect()}
    for i, text in rows:
        before, line, after = text.split("\n")
        assert got[i]["text"] == (text if i % 2 else f"{before}\n{after}") and got[i]["removed_words"] == (0 if i % 2 else len(line.split()))


def test_passages_inside_lines_go_to_their_ends(spark):
    rows, shared = [], {}
    for k, n in enumerate((51, 52, 60, 75, 100, 1500)):
        passage, i = prose(2000 + k, n), 10 * k + 1
        rows += [(i + j, f"{prose(3000 + 10 * k + j, 35)} A{j} {passage} B{j} {prose(4000 + 10 * k + j, 2 * n)}") for j in range(3)]
        shared |= {i + j: passage for j in range(1, 3)}
    quoted, host = prose(2100, 30), prose(2101, 300)  # a smaller document keeps the end of a passage that others share
    rows += [(100, f"{prose(3100, 40)} {quoted} {prose(3101, 40)}"), (101, f"{prose(3102, 400)} C1 {host} {quoted} D1"), (102, f"{prose(3103, 400)} C2 {host} {quoted} D2")]
    unit = prose(2200, 26)  # recurs in its keeper: each end of it is followed where it lies last or first
    rows += [(110, f"{prose(3110, 40)} {unit} x1 {unit} {unit} y {prose(3111, 40)}"), (111, f"{prose(3112, 40)} E {unit} {unit} F {prose(3113, 40)}")]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark, docs(spark, rows)).collect()}
    source = dict(rows)
    for i, passage in shared.items():
        assert got[i]["text"] == source[i].replace(passage + " ", "") and (got[i]["n_removed"], got[i]["removed_words"]) == (1, len(passage.split()))
    assert host.split()[0] not in got[102]["text"] and got[102]["text"].split()[-2:] == ["C2", "D2"]
    assert got[111]["text"] == source[111].replace(f"{unit} {unit} ", "") and got[110]["n_removed"] == 0


@pytest.mark.parametrize("gap", range(7))
def test_gaps_between_neighbouring_paragraphs(gap):
    merged, closed = substring_dedup.merged, gap <= 4
    whole, apart = [(10, 58 + gap)], [(10, 34), (34 + gap, 58 + gap)]
    assert merged([(34 + gap, 58 + gap, 1, 7), (10, 34, 1, 7)]) == (whole if closed else apart)
    for keeper, shift in ((2, 7), (1, 8)):  # another keeper, another place
        assert merged([(10, 34, 1, 7), (34 + gap, 58 + gap, keeper, shift)]) == (whole if gap == 0 else apart)


def test_runs_with_recurring_phrases_place_the_same_paragraphs():
    def keys(*texts):
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        start, end, first = shingles.words_of(raw, np.cumsum([0, *map(len, texts)]))
        placed = substring_dedup.placed_paragraphs(shingles.word_hashes(raw, start, end), first)
        return [set(placed[-2][placed[0] == t].tolist()) for t in range(len(texts))]

    for k in (*range(100), 163, 2556, 3780):  # by chance the last three had no paragraph in common
        phrase, r = prose(k, 8), random.Random(k)
        shared = " ".join(f"{phrase} {prose(10**5 * (j + 1) + k, 2)}" for j in range(6))
        one, two = keys(f"{prose(7 * 10**6 + k, r.randint(30, 90))} {shared} {prose(8 * 10**6 + k, 40)} ", f"{prose(9 * 10**6 + k, r.randint(30, 90))} {shared} {prose(11 * 10**6 + k, 50)}")
        assert one & two
    raw = np.frombuffer(b"so " * 5000, np.uint8)
    flat = substring_dedup.placed_paragraphs(shingles.word_hashes(raw, *shingles.words_of(raw, np.array([0, len(raw)]))[:2]), np.array([0, 5000]))
    assert [x.tolist() for x in flat[:3]] == [[0], [0], [5000]]  # one long paragraph


@pytest.mark.parametrize("name", [n for n in SQL if n.startswith(("op1", "op5"))])
def test_against_sql(name, spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = con.sql(SQL[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))


def test_only_words_that_an_earlier_document_has_are_removed(spark):
    r, rows = random.Random(12), []
    pool = [prose(9000 + k, r.randint(26, 120)) for k in range(6)]
    for i in range(40):
        parts = [prose(9100 + 10 * i + k, r.randint(5, 60)) for k in range(3)]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(pool))
        rows.append((i + 1, r.choice([" ", "\n"]).join(parts)))
    got = {x["doc_id"]: x for x in substring_dedup.substring_dedup(spark, docs(spark, rows)).collect()}
    seen, missed, planted = set(), 0, 0
    for i, text in rows:
        words, shared = text.split(), set()
        for k in range(len(words) - 23):
            if tuple(words[k : k + 24]) in seen:  # brute force: runs of 24 words that an earlier document has
                shared |= set(range(k, k + 24))
        place, removed = [m.span() for m in re.finditer(r"\S+", text)], set()
        for s in got[i]["spans"]:
            removed |= {k for k, (a, b) in enumerate(place) if s["start"] <= a and b <= s["end"]}
        assert removed <= shared and got[i]["removed_words"] == len(removed)
        runs = [k for k in range(len(words) - 50) if set(range(k, k + 51)) <= shared and tuple(words[k : k + 51]) in {w for w in seen if len(w) == 51}]
        planted += len(runs)
        missed += sum(not set(range(k, k + 51)) <= removed for k in runs)
        seen |= {tuple(words[k : k + n]) for n in (24, 51) for k in range(len(words) - n + 1)}
    assert planted > 100 and missed == 0
