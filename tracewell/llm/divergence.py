"""Operator 11, audit of how far the sources of a language differ in their terms, by factorising texts into chunks.

A term is a run of letters and of characters beyond ASCII, A-Z in lower case; none holds white space, so the terms of a text
are those of its chunks between ASCII white space. Chunks are taken in lower case and without what ends them that is no part
of a term. Texts are dealt into blocks of bounded size. A block keeps the chunks of each document as numbers with counts, and
lists its different chunks. These are dealt by their hash, each globally distinct chunk is tokenised once, and where its terms
aren't the chunk itself, they return to the blocks that hold it. Documents move with their block alone. In a block, the
documents that hold a term are distinct by nature, so what blocks have found adds up: occurrences for each (lang, source,
term), documents for each (lang, term). A chunk or term occurs once in a block, however common it is.

Each language keeps its terms in at least LEAST documents. A group or language with N occurrences of the V kept terms gives a
term with `count` of them p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)). Two groups differ at a term by f = floor((p - q)**2
/ (p + q)); all in integers. Pairs of sources are judged as a product of matrices is made: kept terms lie in shards, sources in
blocks, a task holds the cells of one shard and two blocks of sources and returns one sum for each pair; kept terms that neither
block has count by their number. Rows of part `pair` are every other source of the language with the sum over all kept terms,
those of part `term` the TOP terms that a source has more often than its language (p > q).

What moves is packed: a row holds the chunks, terms or cells that a block has for one place.

Defined cases: null text, lang and source are empty strings; each row is a document, whatever its doc_id (null or repeated);
documents without terms still make their group; a language without kept terms has pairs of value 0 and no terms; a single
source has no pairs; equal values rank by the item's UTF-8 bytes; empty tables give empty results; texts are read whole, a
chunk may be as long as one; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, lean, mapped, saved, step

#: A term in UTF-8, and the bytes that are no part of one.
TERM, OTHER = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), bytes(b for b in range(128) if not chr(b).isalpha())

#: Documents of a language that must hold a term, and terms that are reported of a source.
LEAST, TOP = 10, 10
#: Bytes of text in a block and for each shard of chunks and terms, sources in a block of sources, cells that are summed at once.
BLOCK_BYTES, SHARD_BYTES, SOURCES, CELLS = 32 << 20, 8 << 20, 64, 1 << 22


def _batch(rows: list[tuple], ddl: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(ddl.values())], list(ddl))


def _ddl(types: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.string()): "array<string>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{c} {names[t]}" for c, t in types.items())


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal values in the first columns, as (key, rows); a run's rows are read as they come."""
    rows = (r for batch in batches for r in batch.to_pylist())
    names = None

    def key(row):
        nonlocal names
        names = names or list(row)[:keys]
        return tuple(row[c] for c in names)

    return itertools.groupby(rows, key)


def _shards(words: list[bytes], shards: int) -> dict[int, list[int]]:
    """The positions of the words of each shard."""
    of = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % shards
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order], prepend=-1))
    return {int(of[own[0]]): own for own in np.split(order, cuts[1:])} if len(words) else {}


_BLOCKS = {"block": pa.int64(), "kind": pa.int32(), "shard": pa.int64(), "lang": pa.string(), "source": pa.string(), "codes": pa.binary(), "counts": pa.binary(), "sizes": pa.binary(), "words": pa.binary()}


def _blocks(batches, shards: int):
    """For each block, its documents by group (kind 0: codes and counts of their chunks), and its chunks by shard (kind 1)."""
    number = 0

    def emptied(known, groups):
        block = (TaskContext.get().partitionId() << 32) + number
        for (lang, source), (codes, counts, sizes) in groups.items():
            yield _batch([(block, 0, None, lang, source, b"".join(codes), b"".join(counts), np.array(sizes, "<u4").tobytes(), None)], _BLOCKS)
        chunks = list(known)
        rows = [(block, 1, shard, None, None, at.astype("<u4").tobytes(), None, None, b" ".join(chunks[k] for k in at)) for shard, at in _shards(chunks, shards).items()]
        for at in range(0, len(rows), 64):
            yield _batch(rows[at : at + 64], _BLOCKS)

    raw, known, groups, size = {}, {}, {}, 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own = Counter((text or b"").lower().split())  # of bytes: A-Z alone, at ASCII white space alone
            codes = np.empty(len(own), np.int64)
            for k, chunk in enumerate(own):
                code = raw.get(chunk)
                if code is None:
                    bare = chunk.strip(OTHER)
                    code = raw[chunk] = known.setdefault(bare, len(known)) if bare else -1
                codes[k] = code
            has, counts = codes >= 0, np.fromiter(own.values(), "<u4", len(own))
            held = groups.setdefault((lang, source), ([], [], []))
            for to, x in zip(held, (codes[has].astype("<u4").tobytes(), counts[has].tobytes(), int(has.sum())), strict=True):
                to.append(x)
            size += len(text or b"")
            if size >= BLOCK_BYTES:
                yield from emptied(known, groups)
                number, raw, known, groups, size = number + 1, {}, {}, {}, 0
    yield from emptied(known, groups)
    del raw, known, groups
    give_back()


_TERMS = {"block": pa.int64(), "codes": pa.binary(), "words": pa.binary()}


def _tokenised(batches):
    """The chunks of each block whose terms aren't the chunk itself: codes, and terms (between spaces) of each, between line feeds."""
    for _, rows in _runs(batches, 1):
        known: dict[bytes, bytes | None] = {}
        for r in rows:
            codes, found = [], []
            for k, chunk in enumerate(r["words"].split(b" ")):
                terms = known.get(chunk, 0)
                if terms == 0:
                    terms = TERM.findall(chunk)
                    terms = known[chunk] = None if terms == [chunk] else b" ".join(terms)
                if terms is not None:
                    codes.append(k)
                    found.append(terms)
            if codes:
                yield _batch([(r["block"], np.frombuffer(r["codes"], "<u4")[codes].tobytes(), b"\n".join(found))], _TERMS)
    give_back()


_CELLS = {"shard": pa.int64(), "langs": pa.list_(pa.string()), "sources": pa.list_(pa.string()), "words": pa.binary(), "group": pa.binary(), "term": pa.binary(), "docs": pa.binary(), "n": pa.binary()}


def _block_cells(batches, shards: int):
    """For each block and shard of terms: documents and occurrences of each group and term."""
    for _, rows in _runs(batches, 1):
        chunks, changed, groups = {}, {}, []
        for r in rows:
            if r["kind"] == 0:
                groups.append(r)
            else:
                into, parts = (chunks, r["words"].split(b" ")) if r["kind"] == 1 else (changed, [x.split(b" ") for x in r["words"].split(b"\n")])
                into.update(zip(np.frombuffer(r["codes"], "<u4").tolist(), parts, strict=True))
        names: dict[bytes, int] = {}
        width = max(chunks, default=-1) + 1
        sizes, ids = np.zeros(width, np.int64), []
        for code in range(width):
            for t in changed.get(code) or (chunks[code],):
                ids.append(names.setdefault(t, len(names)))
            sizes[code] = len(changed.get(code) or (0,))
        ids, first, terms = np.array(ids, np.int64), np.cumsum(sizes) - sizes, list(names)
        del chunks, changed, names
        cells = []
        for g, r in enumerate(groups):
            codes, counts, lengths = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("codes", "counts", "sizes"))
            doc, n = np.repeat(np.arange(len(lengths)), lengths), sizes[codes]
            at = np.repeat(first[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = np.repeat(doc, n) * len(terms) + ids[at]
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.diff(key[order], prepend=-1))
            total = np.add.reduceat(np.repeat(counts, n)[order], new) if len(new) else np.zeros(0, np.int64)
            term = key[order][new] % max(1, len(terms))
            held = np.bincount(term, minlength=len(terms))
            total = np.bincount(term, total, len(terms)).astype(np.int64)  # exact below 2**53 in a block
            has = np.flatnonzero(held)
            cells.append((np.full(len(has), g), has, held[has], total[has]))
        group, term, docs, n = (np.concatenate(c) for c in zip(*cells, strict=True)) if cells else (np.zeros(0, np.int64),) * 4
        langs, sources = [r["lang"] for r in groups], [r["source"] for r in groups]
        order = np.argsort(term, kind="stable")
        begin = np.searchsorted(term[order], np.arange(len(terms) + 1))
        for shard, own in _shards(terms, shards).items():
            held = begin[own + 1] - begin[own]
            at = order[np.repeat(begin[own] - (np.cumsum(held) - held), held) + np.arange(held.sum())]
            packed = [x.astype("<u4").tobytes() for x in (group[at], np.repeat(np.arange(len(own)), held), docs[at])]
            yield _batch([(shard, langs, sources, b" ".join(terms[k] for k in own), *packed, n[at].tobytes())], _CELLS)
    give_back()


_PACKS = {"shard": pa.int64(), "lang": pa.string(), "side": pa.int32(), "kept": pa.int64(), "sources": pa.list_(pa.string()), "totals": pa.list_(pa.int64()), "words": pa.binary(), "of_lang": pa.binary(), "source": pa.binary(), "term": pa.binary(), "n": pa.binary()}


def side_of(source: str, sides: int) -> int:
    """The block of a source."""
    return zlib.crc32(source.encode()) % sides


def _summed(cells: list[tuple], width: int) -> tuple[np.ndarray, ...]:
    """(key, docs, n) with one entry for each key."""
    key, docs, n = (np.concatenate(c) for c in zip(*cells, strict=True))
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=-1))
    return key[order][new], np.add.reduceat(docs[order], new), np.add.reduceat(n[order], new)


def _kept(batches, least: int, sides: dict[str, int]):
    """For each shard, language and block of sources: occurrences of the kept terms, and of each in the whole language.

    Languages with one block of sources aren't in `sides`. A side of -1 has the number of kept terms and no source.
    """
    wide = 1 << 31  # more groups or terms than a shard has
    for (shard,), rows in _runs(batches, 1):
        names, places, cells, pending = {}, {}, [], 0
        for r in rows:
            term = np.array([names.setdefault(t, len(names)) for t in r["words"].split(b" ")], np.int64)
            group = np.array([places.setdefault(p, len(places)) for p in zip(r["langs"], r["sources"], strict=True)], np.int64)
            g, t, docs = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("group", "term", "docs"))
            cells.append((group[g] * wide + term[t], docs, np.frombuffer(r["n"], np.int64)))
            pending += len(g)
            if pending > CELLS:
                cells, pending = [_summed(cells, wide)], 0
        key, docs, n = _summed(cells, wide)
        group, term, terms, groups = key // wide, key % wide, list(names), list(places)
        langs: dict[str, list[int]] = {}
        for k, (lang, _) in enumerate(groups):
            langs.setdefault(lang, []).append(k)
        for lang, own in langs.items():
            at = np.flatnonzero(np.isin(group, own))
            df, total = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
            np.add.at(df, term[at], docs[at])
            np.add.at(total, term[at], n[at])
            at = at[df[term[at]] >= least]
            if not len(at):
                continue
            yield _batch([(shard, lang, -1, int((df >= least).sum()), [], [], None, None, None, None, None)], _PACKS)
            side = {k: side_of(groups[k][1], sides.get(lang, 1)) for k in own}
            lies = np.array([side.get(k, -1) for k in range(len(groups))])[group[at]]
            for s in np.unique(lies):
                mine = at[lies == s]
                gs, gk = np.unique(group[mine], return_inverse=True)
                ts, tk = np.unique(term[mine], return_inverse=True)
                totals = np.zeros(len(gs), np.int64)
                np.add.at(totals, gk, n[mine])
                yield _batch([(shard, lang, int(s), 0, [groups[g][1] for g in gs], totals.tolist(), b" ".join(terms[t] for t in ts), total[ts].tobytes(), gk.astype("<u4").tobytes(), tk.astype("<u4").tobytes(), n[mine].tobytes())], _PACKS)
    give_back()


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """p of terms with these counts among `total` occurrences of `kept` terms."""
    if len(counts) and 10**9 * (int(counts.max()) + 2) >= 2**63 or total + 2 * kept >= 2**63:
        return np.array([1 + 10**9 * (int(c) + 2) // (total + 2 * kept) for c in counts], np.int64)
    return 1 + 10**9 * (counts + 2) // np.int64(total + 2 * kept)


def difference(p, q):
    """f of two shares; both are 10**9 + 1 at most, so the square fits."""
    return (p - q) ** 2 // (p + q)


_OUT = "lang string, source string, part string, item string, value long"


def _judged(batches, top: int):
    """Sums of f over one shard for each pair of sources of two blocks; if they are the same, also the best terms of its sources."""
    for (_, lang, left, right), rows in _runs(batches, 4):
        packs, info = {}, {}
        for r in rows:
            (packs if r["words"] is not None else info)[r["side"]] = r
        if not info.keys() >= {left, right}:  # a block without sources
            continue
        v, lang_n, kept = (next(iter(info.values()))[c] for c in ("v", "lang_n", "kept"))
        words = {s: r["words"].split(b" ") for s, r in packs.items()}
        names = {t: k for k, t in enumerate(dict.fromkeys(t for own in words.values() for t in own))}
        sides, out = {}, []
        for s, r in info.items():
            source = {x: k for k, x in enumerate(r["sources"])}
            p = np.empty((len(source), len(names)), np.int64)
            none = np.array([shares(np.zeros(1, np.int64), n, v)[0] if v else 1 for n in r["totals"]], np.int64)
            p[:] = none[:, None]
            if s in packs:
                k = packs[s]
                at, term, n = np.frombuffer(k["source"], "<u4"), np.frombuffer(k["term"], "<u4"), np.frombuffer(k["n"], np.int64)
                column = np.array([names[t] for t in words[s]], np.int64)
                q = shares(np.frombuffer(k["of_lang"], np.int64), lang_n, v)
                for g, name in enumerate(k["sources"]):
                    own = np.flatnonzero(at == g)
                    own_p = shares(n[own], r["totals"][source[name]], v)
                    p[source[name], column[term[own]]] = own_p
                    if left == right:
                        more = own_p > q[term[own]]
                        value, item = difference(own_p, q[term[own]])[more], term[own][more]
                        best = sorted(zip((-value).tolist(), (words[s][t] for t in item), strict=True))[:top] if len(value) <= 4 * top else _best(value, item, words[s], top)
                        out += [(lang, name, "term", t.decode(), -x) for x, t in best]
            sides[s] = (r["sources"], none, p)
        (a, a0, ap), (b, b0, bp) = sides[left], sides[right]
        for i, name in enumerate(a):
            value = difference(ap[i][None, :], bp).sum(axis=1) + (kept - len(names)) * difference(a0[i], b0)
            for item, x in zip(b, value.tolist(), strict=True):
                if item != name:
                    out.append((lang, name, "pair", item, x))
                    if left != right:
                        out.append((lang, item, "pair", name, x))
        yield _batch(out, {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()})
    give_back()


def _best(value: np.ndarray, item: np.ndarray, words: list[bytes], top: int) -> list[tuple[int, bytes]]:
    """(-value, term) of the best, all ties at the last place considered."""
    cut = np.partition(value, len(value) - top)[len(value) - top]
    return sorted((-int(value[k]), words[item[k]]) for k in np.flatnonzero(value >= cut))[:top]


def _by(rows: DataFrame, keys: list[str], *then: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *then)


def divergence(spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = lean(docs, "lang", "source", "text").select(text("lang").alias("lang"), text("source").alias("source"), F.col("text").cast("binary").alias("text"))
    shards = max(32, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    with step(spark):
        with step(spark):  # blocks and their shuffles go once the cells are there
            blocks = mapped(rows, lambda b: _blocks(b, shards), _ddl(_BLOCKS), "chunk-blocks")
            groups = saved(blocks.filter("kind = 0").select("lang", "source").distinct(), "source-groups", keep=True)
            with step(spark):
                terms = mapped(_by(blocks.filter("kind = 1").select("shard", "block", "codes", "words"), ["shard"]), _tokenised, _ddl(_TERMS), "chunk-terms", keep=True)
            parts = blocks.select("block", "kind", "lang", "source", "codes", "counts", "sizes", "words").unionByName(terms.withColumn("kind", F.lit(2)), allowMissingColumns=True)
            cells = mapped(_by(parts, ["block"], "kind"), lambda b: _block_cells(b, shards), _ddl(_CELLS), "block-cells", keep=True)
        sides = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("int").alias("sides"))
        many = {r["lang"]: r["sides"] for r in sides.filter("sides > 1").collect()}  # one number for each language with many sources
        with step(spark):
            packs = mapped(_by(cells, ["shard"]), lambda b: _kept(b, least, many), _ddl(_PACKS), "kept-terms", keep=True)
        kept = packs.filter("side < 0").select("shard", "lang", "kept")
        each = packs.filter("side >= 0").select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("s"))
        totals = each.groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.totals").alias("total"))
        by_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_n")).join(kept.groupBy("lang").agg(F.sum("kept").alias("v")), "lang", "full")
        with step(spark):
            own = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"])
            number = F.pmod(F.crc32(F.encode("source", "UTF-8")), F.col("sides")).cast("int")
            own = own.join(sides, "lang").join(by_lang, "lang", "left").fillna(0, ["v", "lang_n"]).withColumn("side", number)
            info = own.groupBy("lang", "side", "sides", "v", "lang_n").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("s"))  # some SOURCES each
            info = saved(info.select("lang", "side", "sides", "v", "lang_n", F.col("s.source").alias("sources"), F.col("s.total").alias("totals")), "source-blocks", keep=True)
        numbers = F.sequence(F.lit(0), F.col("sides") - 1)
        pairs = F.transform(numbers, lambda k: F.struct(F.least("side", k).alias("left"), F.greatest("side", k).alias("right")))
        shard_of = kept.unionByName(info.select(F.lit(-1).cast("long").alias("shard"), "lang", F.lit(0).cast("long").alias("kept")).distinct())  # a language without kept terms has that one
        asked = shard_of.join(info, "lang").withColumn("pair", F.explode(pairs))
        held = packs.filter("side >= 0").join(info.select("lang", "sides").distinct(), "lang").withColumn("pair", F.explode(pairs))
        columns = ["shard", "lang", "pair.left", "pair.right", "side", "sources"]
        work = asked.select(*columns, "totals", "v", "lang_n", "kept").unionByName(held.select(*columns, "words", "of_lang", "source", "term", "n"), allowMissingColumns=True)
        judged = _by(work, ["shard", "lang", "left", "right"]).mapInArrow(lambda b: _judged(b, top), _OUT)
        judged = saved(judged.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "judged")
        rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
        terms = judged.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
        return saved(judged.filter("part = 'pair'").withColumn("rank", rank).unionByName(terms), "divergence", keep=True)
