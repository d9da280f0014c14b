"""Operator 8, removal of passages that repeat across documents, by MinHash banding of paragraphs.

A text is cut into paragraphs of two kinds. Lines of LEAST words or more are its own paragraphs. Overlapping ones of LEAST
words are placed by the words themselves, for passages that sit in the middle of a line: in every WINDOW consecutive starting
points the one with the smallest 5-gram hash (all of equal ones) begins a paragraph, so any run of LEAST + WINDOW - 1 (51)
words that two documents share gives both the same paragraphs. All paragraphs go through MinHash banding on their word
5-grams; those that share a bucket are joined and verified by exact Jaccard similarity (0.8); the components of these links,
and of equal paragraphs, are clusters. Buckets that lie in one document tie nothing together that could be removed, and are
left out.

In a cluster the document with the smallest doc_id keeps its paragraphs and the others lose theirs; repeats within one
document are no matter. Starting points of paragraphs are at most WINDOW words apart, so what a document and its keeper share
beyond a paragraph and its neighbours is less than that: the ends of removals are compared with the keeper word by word over
WINDOW words, and removals reach as far as both agree. Of paragraphs that are similar but not equal, what lies before the
first and after the last 5-gram that both have stays. Spans of neighbouring paragraphs with the same keeper become one. A
row results for each document: doc_id, class_id (the smallest doc_id of the documents tied by removals), n_removed spans,
removed_words, spans (start and end in characters of the whole text) and the text that is left.

Defined cases: null text is empty; documents without repeats keep their text as it is, null as the empty string; a document
all of whose words repeat is left empty; rows that repeat a doc_id are one document, each is cut by its own words, and none
for what another of them holds; rows with a null doc_id are returned as they are, with a null class_id; empty tables give
empty results; texts are read whole.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import give_back, lean, mapped, mix64, saved, step, text_slices
from .components import components
from .ngram_join import similar_classes
from .shingles import _factors, band_hashes, distinct, shingle_hashes, word_hashes, words_of

#: Words of a paragraph at least, and starting points of which one begins a paragraph.
LEAST, WINDOW = 24, 28
#: (bands, values in each), for lines and placed paragraphs alike, so that either kind meets the other. At a similarity of exactly
#: 0.8 a pair misses all bands with a probability of (1 - 0.8**3)**5 = 0.03.
BANDS = (5, 3)
#: Pairs of bucket and paragraph in a shard, about, and pairs that are held before repeats go.
SHARD, HELD = 1 << 20, 1 << 22
#: Shares of the buckets that are compared one after another, so that the disk holds the shingles of one.
ROUNDS = 3

_BUCKETS = [f"b{k}" for k in range(BANDS[0])]
_UNIT = "doc_id long, th long, first int, last int, k1 long, k2 long, " + ", ".join(f"{b} long" for b in _BUCKETS)


def _prefix(hashes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(mix64(np.array([seed], np.uint64))[0]) | 1
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(hashes) - 1), np.uint64(base))]), dtype=np.uint64)[: len(hashes)]
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(hashes) - 1), np.uint64(pow(base, -1, 1 << 64)))]), dtype=np.uint64)[: len(hashes)]
    return np.concatenate([[np.uint64(0)], np.cumsum(hashes * up, dtype=np.uint64)]), down


def _over_windows(values: np.ndarray, least) -> np.ndarray:
    """The minimum or maximum of every WINDOW consecutive values."""
    width = 1
    while width * 2 <= WINDOW:
        values = least(values[:-width], values[width:]) if len(values) > width else values[:0]
        width *= 2
    rest = WINDOW - width
    return least(values[:-rest], values[rest:]) if len(values) > rest else values[:0]


def placed_paragraphs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in it, one past the last, hash, second hash) of the paragraphs that the words of several texts place.

    All of equal minima in a window count, so that the words of a run alone decide. Where equal paragraphs of a text meet or
    overlap they are one, longer than LEAST, that begins and ends as they do.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    n = len(hashes)
    if n < LEAST:
        return none
    with np.errstate(over="ignore"):
        factors = _factors(5)
        grams = np.zeros(n - LEAST + 1, np.uint64)
        for k in range(5):
            grams += hashes[k : k + len(grams)] * factors[k]
    ranked = mix64(grams)
    counts = np.maximum(np.diff(first) - LEAST + 1, 0)  # starting points of each text
    windows = np.maximum(counts - WINDOW + 1, 0)
    full = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    # a starting point is chosen if the largest minimum of the windows that hold it is its own
    minima = np.zeros(len(ranked) + WINDOW - 1, np.uint64)
    if len(full):
        minima[full + WINDOW - 1] = _over_windows(ranked, np.minimum)[full]
    chosen = _over_windows(minima, np.maximum) == ranked if len(full) else np.zeros(len(ranked), bool)
    for t in np.flatnonzero((counts > 0) & (windows <= 1)):  # one window or less
        own = slice(int(first[t]), int(first[t] + counts[t]))
        chosen[own] = ranked[own] == ranked[own].min()
    at = np.flatnonzero(chosen)
    if not len(at):
        return none
    text = np.searchsorted(first, at, side="right") - 1
    out = []
    with np.errstate(over="ignore"):
        for seed in (11, 12):
            total, down = _prefix(hashes, seed)
            out.append(mix64((total[at + LEAST] - total[at]) * down[at]))
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (out[0][1:] != out[0][:-1]) | (out[1][1:] != out[1][:-1]) | (np.diff(at) > LEAST)])
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + LEAST
    text, at = text[new], at[new]
    return text, at - first[text], last - first[text], out[0][new], out[1][new]


def line_words(raw: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, one past the last) of every line of LEAST words or more; words count from the start of the text."""
    line = np.searchsorted(np.flatnonzero(raw == 10), start)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])]) if len(start) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(start))
    long = b - a >= LEAST
    a, b = a[long], b[long]
    return text[a], a - first[text[a]], b - first[text[a]]


def cut_paragraphs(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """(text, first, last, k1, k2, bands) of the paragraphs of several texts."""
    start, end, first = words_of(raw, offsets)
    hashes = word_hashes(raw, start, end)
    text, word, last, k1, k2 = placed_paragraphs(hashes, first)
    at = first[text] + word
    own, a, b = line_words(raw, start, first)
    lengths, begin = b - a, first[own] + a
    # one hash of every shingle for each value: placed paragraphs take the minimum of those of their first LEAST words, lines of all
    grams, _ = shingle_hashes(hashes, np.array([0, len(hashes)]))
    values = BANDS[0] * BANDS[1]
    sig = np.empty((len(at) + len(own), values), np.uint32)
    ranges = np.stack([begin, begin + lengths - 4], axis=1).ravel()
    seeds = mix64(np.arange(1, 2 * values + 1, dtype=np.uint64))
    for k in range(values if len(at) or len(own) else 0):
        with np.errstate(over="ignore"):
            v = grams * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1]
        if len(at):
            low, width = v, 1
            while 2 * width <= LEAST - 4:
                low, width = np.minimum(low[:-width], low[width:]), 2 * width
            sig[: len(at), k] = np.minimum(low[at], low[at + LEAST - 4 - width]) >> np.uint64(32)
        if len(own):
            sig[len(at) :, k] = np.minimum.reduceat(np.append(v, v[-1]), ranges)[::2] >> np.uint64(32)
    with np.errstate(over="ignore"):
        keys = []
        for seed in (11, 12):
            total, down = _prefix(hashes, seed)
            keys.append(mix64((total[begin + lengths] - total[begin]) * down[begin]) if len(own) else np.zeros(0, np.uint64))
    both = [np.concatenate(x) for x in ((text, own), (word, a), (last, b), (k1, keys[0]), (k2, keys[1]))]
    return [*both, band_hashes(sig, *BANDS)]


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, first, last, k1, k2, b0, ...) of every paragraph of (doc_id, th, text) rows; k1 and k2 name its words, the others are its buckets."""

    def run(batches):
        for batch in batches:
            for at, _, raw, offsets in text_slices(batch, "text"):
                text, first, last, k1, k2, bands = cut_paragraphs(raw, offsets)
                of = pa.array(text + at)
                columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), *map(pa.array, bands.T.copy())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _UNIT.split(", ")])

    return mapped(docs, run, _UNIT, "paragraphs")


def paragraph_sets(docs: DataFrame, found: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, size, sig, shingles) of one paragraph of each k1 among the ids; shingles are 32 bits of their hashes."""
    with step(docs.sparkSession):
        with step(docs.sparkSession):
            one = found.join(ids.withColumnRenamed("id", "k1"), "k1").groupBy("k1").agg(F.min(F.struct("doc_id", "th", "first", "last")).alias("u"))
            places = one.groupBy("u.doc_id", "u.th").agg(F.collect_list(F.struct("k1", "u.first", "u.last")).alias("places"))  # of one document
            places = saved(places, "asked-paragraphs", keep=True)

        def run(batches):
            for batch in batches:
                places = batch.column(1)
                for row, n, raw, offsets in text_slices(batch, "text"):
                    start, end, first = words_of(raw, offsets)
                    hashes = word_hashes(raw, start, end)
                    own = places.slice(row, n)
                    text = np.repeat(np.arange(n), pa.compute.list_value_length(own).to_numpy(zero_copy_only=False))
                    k1, a, b = (x.to_numpy() for x in own.flatten().flatten())
                    lengths = (b - a).astype(np.int64)
                    cuts = np.concatenate([[0], np.cumsum(lengths)])
                    words = np.repeat(first[text] + a - cuts[:-1], lengths) + np.arange(cuts[-1])
                    grams, bounds = shingle_hashes(hashes[words], cuts)
                    sets = distinct((grams >> np.uint64(32)).astype("<u4"), bounds)
                    yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])

        sets = None
        for share in range(ROUNDS):
            of = lambda rows: rows.filter(F.pmod(F.hash("doc_id"), F.lit(ROUNDS)) == share)  # noqa: B023, E731
            with step(docs.sparkSession):
                own = mapped(of(docs).join(of(places), ["doc_id", "th"]).select("text", "places"), run, "id long, shingles binary", "paragraph-sets", keep=2)
            sets = own if sets is None else sets.unionByName(own)
    # rows that repeat a document repeat its paragraphs
    return sets.dropDuplicates(["id"]).select("id", F.lit(1).cast("long").alias("size"), F.lit(None).cast("binary").alias("sig"), "shingles")


def _dealt(batches, shards: int):
    """Packed rows (shard, keys, values, docs, sizes) of rows (key, value, doc, size)."""
    for batch in _lots(batches, 1 << 17):
        own, values, docs, sizes = (batch.column(k).combine_chunks().to_numpy() for k in range(4))
        of = (own.view(np.uint64) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)
        order = np.argsort(of, kind="stable")
        of = of[order].astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, int)
        parts = [[x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)] for x in (own[order], values[order], docs[order], sizes[order])]
        yield pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]]), *(pa.array(x, pa.binary()) for x in parts)], ["shard", "keys", "vals", "docs", "sizes"])


def _lots(batches, rows: int):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _once(keys: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different pairs of key and value, in order, with the first and last document that has each."""
    if not len(keys):
        return keys, values, low, high, sizes
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])]))
    return keys[start], values[start], np.minimum.reduceat(low[order], start), np.maximum.reduceat(high[order], start), sizes[order][start]


def _several(keys: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows whose key lies in several documents."""
    order = np.argsort(keys)
    start = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.zeros(0, int)
    wide = np.minimum.reduceat(low[order], start) < np.maximum.reduceat(high[order], start) if len(keys) else np.zeros(0, bool)
    at = order[np.repeat(wide, np.diff(np.append(start, len(keys))))]
    return keys[at], values[at], low[at], high[at], sizes[at]


def _shared(batches, members: bool):
    """Of the keys with several values that several documents hold: the key, each value, its size and the smallest value; or without `members` the keys alone.

    Rows come by shard. What a task holds is the different pairs of one shard, 36 bytes each.
    """
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, own in itertools.groupby(rows, lambda r: r[0]):
        held, pending = [(*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.int32))], 0
        for _, keys, values, docs, sizes in own:
            doc = np.frombuffer(docs, np.int64)
            held.append((np.frombuffer(keys, np.int64), np.frombuffer(values, np.int64), doc, doc, np.frombuffer(sizes, np.int32)))
            pending += len(doc)
            if pending > HELD:
                held, pending = [_once(*map(np.concatenate, zip(*held, strict=True)))], 0
        keys, values, _, _, sizes = _once(*_several(*map(np.concatenate, zip(*held, strict=True))))
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        count = np.diff(np.append(start, len(keys)))
        if members:
            many, least = np.repeat(count > 1, count), np.repeat(values[start], count)
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (keys, values, sizes, least)], ["bucket", "id", "n", "least"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(keys[start[count > 1]])], ["k1"])
    give_back()


def shared_keys(rows: DataFrame, shards: int, members: bool, keep: int = 1) -> DataFrame:
    """Of rows (key, value, doc, size): (bucket, id, n, least), the different values of keys that several have, or without `members` (k1), such keys.

    Keys that one document alone holds tie it to no other and are left out.
    """
    with step(rows.sparkSession):
        dealt = rows.mapInArrow(lambda b: _dealt(b, shards), "shard long, keys binary, vals binary, docs binary, sizes binary")
        dealt = dealt.repartition("shard").sortWithinPartitions("shard")
        return mapped(dealt, lambda b: _shared(b, members), "bucket long, id long, n int, least long" if members else "k1 long", "shared-keys", keep)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, id, n, least) of paragraphs in buckets of several different ones, and (doc_id, th, first, last, k1, k2) of all
    that are among these or lie in several documents."""
    spark = docs.sparkSession
    with step(spark):
        units = paragraphs(docs)
        n = units.count()
        with step(spark):
            shards, size = max(32, n // SHARD), (F.col("last") - F.col("first")).alias("n")
            members = [shared_keys(units.select(b, "k1", "doc_id", size), shards, True, keep=3) for b in _BUCKETS]  # the disk holds the shuffle of one band
            members = functools.reduce(DataFrame.unionByName, members)
            equal = shared_keys(units.select("k1", "doc_id", F.col("doc_id").alias("d"), F.lit(0).alias("n")), shards, False)
            wanted = saved(equal.unionByName(members.select(F.col("id").alias("k1"))).distinct(), "wanted-paragraphs", keep=True)
        found = saved(units.select("doc_id", "th", "first", "last", "k1", "k2").join(wanted, "k1"), "candidate-paragraphs", keep=True)
        return members, found


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, first, last, keeper, kth, kfirst, klast, equal): paragraphs of a cluster that an earlier document keeps, and
    where: an equal one, or else its first of the cluster."""
    spark = docs.sparkSession
    with step(spark):
        members, units = candidates(docs)
        near = similar_classes(members, lambda ids: paragraph_sets(docs, units, ids), word="<u4", whole=False, rounds=ROUNDS)
        with step(spark):
            # without links to others, both hashes make a cluster
            cluster = [F.coalesce("label", "k1").alias("cluster"), F.when(F.col("label").isNull(), F.col("k2")).otherwise(F.lit(0)).alias("sub")]
            held = units.join(near.select(F.col("id").alias("k1"), "label"), "k1", "left").select("doc_id", "th", "first", "last", "k1", *cluster)
            held = saved(held, "clustered-paragraphs", keep=True)
        with step(spark):
            keepers = held.groupBy("cluster", "sub").agg(F.min(F.struct("doc_id", "th", "first", "last")).alias("k"), F.max("doc_id").alias("top")).filter("k.doc_id < top")
            keepers = keepers.select("cluster", "sub", F.col("k.doc_id").alias("keeper"), F.col("k.th").alias("kth"), F.col("k.first").alias("kfirst"), F.col("k.last").alias("klast"))
            rows = saved(held.join(keepers, ["cluster", "sub"]), "kept-paragraphs", keep=True)
        same = rows.filter("doc_id = keeper AND th = kth").groupBy("cluster", "sub", "k1").agg(F.min("first").alias("efirst"), F.max("last").alias("elast"))
        found = rows.filter("doc_id > keeper").join(same, ["cluster", "sub", "k1"], "left")
        places = [F.coalesce("efirst", "kfirst").alias("kfirst"), F.coalesce("elast", "klast").alias("klast"), F.col("efirst").isNotNull().alias("equal")]
        return saved(found.select("doc_id", "th", "first", "last", "keeper", "kth", *places), "repeated-paragraphs", keep=True)


def _words_beside(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, th, side, at, n, words): 32-bit hashes of at most n words from each asked place on, or before it, nearest first."""
    places = asked.groupBy("doc_id", "th").agg(F.collect_set(F.struct("side", "at", "n")).alias("places"))  # of one document

    def run(batches):
        for batch in batches:
            places = batch.column(3)
            for row, n, raw, offsets in text_slices(batch, "text"):
                start, end, first = words_of(raw, offsets)
                hashes = (word_hashes(raw, start, end) >> np.uint64(32)).astype(np.uint32)
                own = places.slice(row, n)
                text = np.repeat(np.arange(n), pa.compute.list_value_length(own).to_numpy(zero_copy_only=False))
                side, at, most = (x.to_numpy() for x in own.flatten().flatten())
                length = np.diff(first)[text]
                counts = np.clip(np.where(side > 0, length - at, at), 0, most)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                k = np.arange(cuts[-1]) - np.repeat(cuts[:-1], counts)
                words = hashes[np.repeat(first[text] + at, counts) + np.where(np.repeat(side, counts) > 0, k, -1 - k)]
                held = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(words)])
                of = pa.array(text + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(side), pa.array(at), pa.array(most), held], ["doc_id", "th", "side", "at", "n", "words"])

    held = docs.join(places, ["doc_id", "th"]).select("doc_id", "th", "text", "places")
    return mapped(held, run, "doc_id long, th long, side int, at int, n int, words binary", "words-beside")


_SPAN = "doc_id long, th long, first int, last int, keeper long, shift int"


def agreement(words: np.ndarray, kept: np.ndarray) -> tuple[int, int, int]:
    """(first, last, first place in the keeper's) of the words from the first to the last 5-gram that both have; all if none is."""
    own, theirs = (np.lib.stride_tricks.sliding_window_view(x, 5) if len(x) >= 5 else np.zeros((0, 5), np.uint32) for x in (words, kept))
    place = {g.tobytes(): j for j, g in reversed(list(enumerate(theirs)))}
    found = [i for i, g in enumerate(own) if g.tobytes() in place]
    return (found[0], found[-1] + 5, place[own[found[0]].tobytes()]) if found else (0, len(words), 0)


def _agreeing(batches):
    """Spans of the words that the document and its keeper share: beside ends, or within similar paragraphs."""
    for batch in batches:
        out = [[] for _ in range(3)]
        for side, at, kat, within, x, y in zip(*(batch.column(k).to_pylist() for k in range(3, 9)), strict=True):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            if within:
                a, b, k = agreement(x, y)
                span = at + a, at + b, at + a - kat - k
            else:
                n = min(len(x), len(y))
                differ = np.flatnonzero(x[:n] != y[:n])
                n = int(differ[0]) if len(differ) else n
                span = (at, at + n, at - kat) if side > 0 else (at - n, at, at - kat)
            for c, v in zip(out, span, strict=True):
                c.append(v)
        a, b, shift = (np.array(c, np.int32) for c in out)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a), pa.array(b), batch.column(2), pa.array(shift)], [c.split()[0] for c in _SPAN.split(", ")]).filter(pa.array(a < b))


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, th, first, last, keeper, shift): words to remove, the document that keeps them, and how far off they are there.

    A paragraph may recur in its keeper: its start is compared with the first place there, its end with the last. Ends that
    meet another removal of the same keeper at the same distance need no comparison. Of a paragraph that is similar to its
    keeper's but not equal, all from the first to the last 5-gram that both have goes.
    """
    spark = docs.sparkSession
    with step(spark):
        every = repeated_paragraphs(docs)
        hits = every.filter("equal").select("*", (F.col("first") - F.col("kfirst")).alias("shift"), (F.col("last") - F.col("klast")).alias("ahead"))
        chain = Window.partitionBy("doc_id", "th", "keeper", "kth", "shift").orderBy("first", "last")
        ends = hits.select("*", F.lag("last").over(chain).alias("before"), F.lag("ahead").over(chain).alias("turn"), F.lead("first").over(chain).alias("after"))
        name, most = ["doc_id", "th", "keeper", "kth"], [F.lit(WINDOW).alias("n"), F.lit(WINDOW).alias("kn"), F.lit(False).alias("within")]
        left = ends.filter("before IS NULL OR before < first OR turn <> shift").select(*name, F.lit(-1).alias("side"), F.col("first").alias("at"), (F.col("first") - F.col("shift")).alias("kat"), *most)
        right = ends.filter("after IS NULL OR after > last OR ahead <> shift").select(*name, F.lit(1).alias("side"), F.col("last").alias("at"), (F.col("last") - F.col("ahead")).alias("kat"), *most)
        similar = every.filter("NOT equal").select(*name, F.lit(1).alias("side"), F.col("first").alias("at"), F.col("kfirst").alias("kat"), (F.col("last") - F.col("first")).alias("n"), (F.col("klast") - F.col("kfirst")).alias("kn"), F.lit(True).alias("within"))
        edges = saved(left.unionByName(right).unionByName(similar).distinct(), "compared-places")
        with step(spark):
            asked = edges.select("doc_id", "th", "side", "at", "n").unionByName(edges.select(F.col("keeper").alias("doc_id"), F.col("kth").alias("th"), "side", F.col("kat").alias("at"), F.col("kn").alias("n")))
            words = _words_beside(docs, asked)
            theirs = words.select(F.col("doc_id").alias("keeper"), F.col("th").alias("kth"), "side", F.col("at").alias("kat"), F.col("n").alias("kn"), F.col("words").alias("kept"))
            both = edges.join(words, ["doc_id", "th", "side", "at", "n"]).join(theirs, ["keeper", "kth", "side", "kat", "kn"])
            found = mapped(both.select("doc_id", "th", "keeper", "side", "at", "kat", "within", "words", "kept"), _agreeing, _SPAN, "agreeing-words", keep=True)
        own = hits.select("doc_id", "th", "first", "last", "keeper", "shift")
        return saved(own.unionByName(found), "removals", keep=True)


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Spans of (first, last, keeper, shift) as disjoint ones; gaps that two windows leave between them are closed."""
    out: list[list] = []
    for first, last, keeper, shift in sorted(spans, key=lambda s: (s[0], s[1])):
        if out and (first <= out[-1][1] or ([keeper, shift] == out[-1][2:] and first - out[-1][1] <= WINDOW - LEAST)):
            if last >= out[-1][1]:
                out[-1][1:] = last, keeper, shift
        else:
            out.append([first, last, keeper, shift])
    return [(a, b) for a, b, _, _ in out]


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]], int]:
    """The text without the words of the spans and the white space after each, the spans in characters, and the words."""
    raw = text.encode()
    start, end, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    parts, found, at, words = [], [], 0, 0
    for a, b in spans:
        b = min(b, len(start))
        if a >= b:
            continue
        parts.append(raw[at : start[a]])
        found.append((len(raw[: start[a]].decode()), len(raw[: end[b - 1]].decode())))
        words += b - a
        at = int(start[b]) if b < len(start) else len(raw)
    parts.append(raw[at:])
    left = b"".join(parts).decode()
    return left.rstrip(" \t\n\v\f\r") if found and at == len(raw) else left, found, words


_OUT = "doc_id long, class_id long, n_removed int, removed_words long, spans array<struct<start: int, end: int>>, text string"


def _hashed(docs: DataFrame) -> DataFrame:
    """`docs` with a hash of their texts beside the doc_id, since rows may repeat that."""
    return docs.withColumn("__th", F.xxhash64("text"))


def document_removals(docs: DataFrame) -> DataFrame:
    """(__id, __own) of every document that loses words, of rows (doc_id, __th, text): the removals of each of its texts."""
    with step(docs.sparkSession):
        hits = removals(docs.filter("doc_id IS NOT NULL").select("doc_id", F.col("__th").alias("th"), "text"))
        own = hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last", "keeper", "shift")).alias("hits"))  # of one document
        own = own.groupBy("doc_id").agg(F.collect_list(F.struct("th", "hits")).alias("__own"))
        return saved(own.select(F.col("doc_id").alias("__id"), "__own"), "document-removals", keep=True)


def _beside(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The documents with what is known of their doc_id, and the removals of their own text as `__hits`."""
    held = docs.join(known.hint("shuffle_hash"), docs["doc_id"] == known["__id"], "left")
    return held.withColumn("__hits", F.get(F.filter("__own", lambda o: o["th"] == F.col("__th")), F.lit(0))["hits"])


def _spans(hits) -> list[tuple[int, int]]:
    return merged([(s["first"], s["last"], s["keeper"], s["shift"]) for s in hits])


def substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each document."""
    rows = _hashed(lean(docs, "doc_id", "text"))
    with step(spark):
        hits = document_removals(rows)
        ties = hits.select(F.col("__id").alias("a"), F.explode(F.flatten(F.transform("__own", lambda o: o["hits"]))).alias("h")).select("a", F.col("h.keeper").alias("b")).distinct()
        labels = components(ties).select(F.col("node").alias("__id"), F.col("label").alias("class_id"))
        known = saved(labels.join(hits, "__id", "left"), "tied-documents", keep=True)

    def run(batches):
        for batch in batches:
            ids, hits, n = batch.column(0), batch.column(3), batch.num_rows
            text = batch.column(1).fill_null("")
            found, words, spans, left = np.zeros(n, np.int32), np.zeros(n, np.int64), [[]] * n, []
            touched = np.flatnonzero(hits.is_valid().to_numpy(zero_copy_only=False))  # other texts stay as they are
            for k in touched:
                rest, own, words[k] = cut(text[k].as_py(), _spans(hits[k].as_py()))
                found[k], spans[k] = len(own), [{"start": a, "end": b} for a, b in own]
                left.append(rest)
            if len(touched):
                mask = np.zeros(n, bool)
                mask[touched] = True
                text = pa.compute.replace_with_mask(text, pa.array(mask), pa.array(left, text.type))
            class_id = pa.compute.coalesce(batch.column(2), ids)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([ids, class_id, pa.array(found), pa.array(words), pa.array(spans, kind), text], ["doc_id", "class_id", "n_removed", "removed_words", "spans", "text"])

    return _beside(rows, known).select("doc_id", "text", "class_id", "__hits").mapInArrow(run, _OUT)


@F.pandas_udf(StringType())
def _left(texts: pd.Series, hits: pd.Series) -> pd.Series:
    return pd.Series([t if h is None else cut(t, _spans(h))[0] for t, h in zip(texts, hits, strict=True)], dtype=object)


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with all their columns and the texts that are left; documents left without words go."""
    rows = _hashed(docs)
    found = _beside(rows, document_removals(rows.select("doc_id", "__th", "text"))).withColumn("text", _left("text", "__hits"))
    return found.filter(F.col("__hits").isNull() | (F.col("text") != "")).select(*docs.columns)
