"""Operator 13, prefix trie of conversations, rolled up by bands of depth.

Conversations are rebuilt: conversation c takes the first h turns of conversation c - c % 20 (all if it has fewer, none if it is
absent; h is crc32 of the decimal c modulo 4) and then its own after its first h. Each different sequence of first d turns, each
a role and a text, is a node of depth d, from the textless root; the conversations that start with it are its members, and its
name is the smallest of them.

No conversation is gathered in one place. Turns are sorted over all partitions; a partition numbers what it holds, and the driver
carries one number for each partition to the next. In the same way the key of a prefix, 128 bits, is the exclusive or of the
hashed turns up to there, each with its depth. A node is a key and a depth, and rows of equal nodes are counted before the
shuffle.

Subtree totals go up by bands of HEIGHT levels: a node explodes only to its ancestors within its band, found in the rows of its
naming conversation; the totals of band roots form a trie of their own, HEIGHT times as low, that is rolled up the same way; and
its completed totals explode once, to the ancestors in the band above each band root. A node makes at most 2 * HEIGHT rows a
level, and there are log(depth) levels to base HEIGHT.

Defined cases: null role or text is the empty string; a null turn comes first; turns of one conversation with equal numbers go
by role, text; repeated rows are turns each; rows with a null conv_id take no part; conversations that are left without turns
are members of the root and end there; an empty table has no nodes; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mapped, mix64, saved, step

WORD = "[^\\x20\\x09-\\x0D]+"

#: Levels of a band, conversations that share a base, and turns of it that may be taken over, less one.
HEIGHT, SHARING, HEADS = 16, 20, 4
#: Bytes of a piece of a list of members.
PIECE = 1 << 20

KEY = ["depth", "k1", "k2"]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from those before; the first is no start, as it may go on from what came before."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _numbered(batches):
    """Sorted rows with their place in their conversation, as far as this partition holds it."""
    part, now, done = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        n = len(conv)
        if not n:
            continue
        start = np.concatenate([[0], _starts(conv)])
        place = np.arange(1, n + 1) - np.repeat(start, np.diff(np.append(start, n)))
        if conv[0] == now:
            place[: start[1] if len(start) > 1 else n] += done
        now, done = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), batch.column(0), pa.array(place), batch.column(1), batch.column(2)], ["part", "conv_id", "place", "words", "digest"])


def _keyed(batches):
    """Sorted rows with the key of the prefix they end, as far as this partition holds it, and of their own turn."""
    part, now, k = TaskContext.get().partitionId(), None, np.zeros(2, np.uint64)
    for batch in batches:
        conv, depth = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        n = len(conv)
        if not n:
            continue
        own = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(n, 2)
        with np.errstate(over="ignore"):
            at = mix64(depth.astype(np.uint64))
            own = np.stack([mix64(own[:, 0] + at), mix64(own[:, 1] ^ (at * np.uint64(0x9E3779B97F4A7C15)))], axis=1)
        upto = np.bitwise_xor.accumulate(own, axis=0)
        start = np.concatenate([[0], _starts(conv)])
        before = np.concatenate([k[None, :] if conv[0] == now else np.zeros((1, 2), np.uint64), upto[start[1:] - 1]])
        upto ^= np.repeat(before, np.diff(np.append(start, n)), axis=0)
        now, k = conv[-1], upto[-1]
        keys = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (*upto.T, *(upto ^ own).T)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), batch.column(0), batch.column(1), batch.column(2), *keys], ["part", "conv_id", "depth", "words", "k1", "k2", "p1", "p2"])


def _carried(rows: DataFrame, of: list[str], at: str, plus, none) -> DataFrame:
    """(part, conv_id, *c_...) of the partitions whose first conversation has begun in earlier ones: what those hold of the columns `of`.

    The driver sees one row for each partition.
    """
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", at, *of)).alias("last")).orderBy("part").collect()
    out, now, held = [], None, none
    for r in ends:
        own = tuple(r["last"][c] for c in of)
        begun = held if r["first"] == now else none
        if begun != none:
            out.append((r["part"], r["first"], *begun))
        now, held = r["last"]["conv_id"], plus(begun, own) if r["first"] == r["last"]["conv_id"] else own
    return rows.sparkSession.createDataFrame(out, "part int, conv_id long, " + ", ".join(f"c_{c} long" for c in of))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, words, digest) of every turn; digest is 16 bytes of its role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = lean(turns, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(" "), "role", "text"), 256)), 1, 16)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.regexp_count("text", F.lit(WORD)).alias("words"), digest.alias("digest"))
    found = mapped(dealt, _numbered, "part int, conv_id long, place long, words int, digest binary", "numbered-turns")
    before = _carried(found, ["place"], "place", lambda a, b: (a[0] + b[0],), (0,))
    whole = found.join(F.broadcast(before), ["part", "conv_id"], "left")
    return whole.select("conv_id", (F.col("place") + F.coalesce("c_place", F.lit(0))).alias("place"), "words", "digest")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every rebuilt conversation, and (conv_id, depth, words, digest) of their turns."""
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    convs = convs.select("conv_id", "n", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARING).alias("base"))
    with step(turns.sparkSession):
        of = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("has"))
        convs = saved(convs.join(of, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))), "conversations", keep=True)
    heads = turns.filter((F.col("place") < HEADS) & (F.col("conv_id") % SHARING == 0)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "taken").join(heads, "base").filter("place <= taken").select("conv_id", F.col("place").alias("depth"), "words", "digest")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "words", "digest")
    return convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), first.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, words, k1, k2, p1, p2): the key of each prefix and of the one before."""
    dealt = turns.select("conv_id", "depth", "words", "digest").repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    found = mapped(dealt, _keyed, "part int, conv_id long, depth long, words int, k1 long, k2 long, p1 long, p2 long", "prefixes")
    before = _carried(found, ["k1", "k2"], "depth", lambda a, b: (a[0] ^ b[0], a[1] ^ b[1]), (0, 0))
    whole = found.join(F.broadcast(before), ["part", "conv_id"], "left")
    held = lambda c, k: F.col(c).bitwiseXOR(F.coalesce(k, F.lit(0))).alias(c)
    return whole.select("conv_id", "depth", "words", held("k1", "c_k1"), held("k2", "c_k2"), held("p1", "c_k1"), held("p2", "c_k2"))


_ENDS = "depth long, k1 long, k2 long, least long, sha string, piece binary"


def _listed(batches):
    """Digests of the members of each node of a sorted partition; of its first and last node, which others may hold too, the members."""
    inner, now, pieces = False, None, []

    def row(sha, piece, least):
        return (*now, least, sha, piece)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((*[pa.int64()] * 4, pa.string(), pa.binary()))], [c.split()[0] for c in _ENDS.split(", ")])

    for batch in batches:
        keys, conv = np.stack([batch.column(k).to_numpy() for k in range(3)]), batch.column(3).to_numpy()
        if not len(conv):
            continue
        start = np.concatenate([[0], _starts(*keys)])
        for a, b in zip(start, np.append(start[1:], len(conv)), strict=True):
            key = tuple(keys[:, a].tolist())
            if key != now:
                if now is not None:
                    # the first node's pieces stay as they are; an inner one is whole
                    yield batch_of([row(hashlib.sha256(b",".join(p for _, p in pieces)).hexdigest(), None, pieces[0][0])] if inner else [row(None, p, x) for x, p in pieces])
                    inner = True
                now, pieces = key, []
            for at in range(a, b, PIECE // 20):
                some = conv[at : min(b, at + PIECE // 20)]
                pieces.append((int(some[0]), b",".join(str(c).encode() for c in some.tolist())))
            if not inner and len(pieces) > 8:  # a node over the whole partition
                yield batch_of([row(None, p, x) for x, p in pieces])
                pieces = []
    if now is not None:
        yield batch_of([row(None, p, x) for x, p in pieces])


def _streamed(batches):
    """The digest of each node from its pieces, which come in order."""
    now, sha = None, None

    def done():
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([sha.hexdigest()])], [*KEY, "sha"])

    for batch in batches:
        for depth, k1, k2, piece in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if (depth, k1, k2) != now:
                if now is not None:
                    yield done()
                now, sha = (depth, k1, k2), hashlib.sha256(piece)
            else:
                sha.update(b",")
                sha.update(piece)
    if now is not None:
        yield done()


def ends(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end."""
    last = rows.select("conv_id", *KEY).join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    dealt = last.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    with step(rows.sparkSession):
        found = mapped(dealt, _listed, _ENDS, "ends")
        pieces = found.filter("sha IS NULL").repartition(*KEY).sortWithinPartitions(*KEY, "least").select(*KEY, "piece")
        whole = pieces.mapInArrow(_streamed, "depth long, k1 long, k2 long, sha string")
        return saved(found.filter("sha IS NOT NULL").select(*KEY, "sha").unionByName(whole).withColumnRenamed("sha", "ends_sha256"), "end-digests", keep=True)


def rolled_up(nodes: DataFrame, rows: DataFrame, top: int, unit: int = 1) -> DataFrame:
    """(depth, k1, k2, leaves, saved): the sums over each node's subtree.

    `nodes` (conv_id, depth, k1, k2, leaves, saved) and `rows` (conv_id, depth, k1, k2) have depths divisible by `unit`, `top` at most.
    """
    band = unit * HEIGHT
    of = rows.select(F.col("conv_id").alias("c"), F.floor(F.col("depth") / band).alias("b"), F.col("depth").alias("d"), "k1", "k2")
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    up = lambda low, condition: low.join(of, condition).groupBy(F.col("d").alias("depth"), "k1", "k2").agg(*sums)
    low = nodes.select("conv_id", "depth", "leaves", "saved")
    within = up(low, (F.col("conv_id") == F.col("c")) & (F.floor(F.col("depth") / band) == F.col("b")) & (F.col("d") <= F.col("depth")))
    if top < band:
        return within
    within = saved(within, "band-totals")
    roots = saved(nodes.select("conv_id", *KEY).filter(F.col("depth") % band == 0).join(within, KEY), "band-roots")
    full = rolled_up(roots, rows.filter(F.col("depth") % band == 0), top, band)
    full = saved(full.filter("depth > 0").join(roots.select("conv_id", *KEY), KEY).select("conv_id", "depth", "leaves", "saved"), "completed-roots")
    above = up(full, (F.col("conv_id") == F.col("c")) & (F.floor(F.col("depth") / band) - 1 == F.col("b")))
    return within.unionByName(above).groupBy(*KEY).agg(*sums)


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    with step(spark):
        with step(spark):
            turns = saved(numbered_turns(conversations), "turns", keep=True)
        lengths, held = rebuilt(turns)
        with step(spark):
            lengths = saved(lengths, "lengths", keep=True)
            none = F.lit(None).cast("long")
            root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).alias("words"), *[F.lit(0).cast("long").alias(k) for k in ("k1", "k2")], none.alias("p1"), none.alias("p2"))
            rows = saved(prefixes(held).unionByName(root), "prefix-rows", keep=True)
        with step(spark):
            nodes = saved(rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2")), "nodes")
            children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
            nodes = nodes.join(children, KEY, "left").fillna(0, ["n_children"])
            nodes = saved(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "trie-nodes", keep=True)
        top = nodes.agg(F.max("depth")).first()[0] or 0
        totals = rolled_up(nodes.select("conv_id", *KEY, "leaves", "saved"), rows.select("conv_id", *KEY), top)
        out = nodes.drop("leaves", "saved").join(totals, KEY).join(ends(rows, lengths), KEY, "left")
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
        out = saved(out, "totalled-nodes").join(parents, ["depth", "p1", "p2"], "left")
        out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
        return saved(out, "prefix-trie", keep=True)
