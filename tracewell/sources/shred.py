"""XML documents as a table of elements (SRC2), the one step that leaves the JVM.

A document comes in slices, which go to a temporary file where it is large; it is checked and then read in pieces. An
element's row is given out when the element ends, so a task holds the open elements, a batch of slices and one of rows, whatever
the documents' sizes. A document that isn't well formed is read whole; it gives one row with the error, and the elements that can be recovered: an end without a beginning is skipped, an element is closed where one around it or the
document ends, stray ampersands and unknown references are text, and so is what looks like no tag. Names are kept without their prefix, attributes with it; comments and instructions are skipped; no
external entity is read. An xpath counts each element among its siblings of the same name.
"""

from __future__ import annotations

import re
import tempfile
from itertools import accumulate
from typing import NamedTuple
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PIECE, _ROWS = 1 << 18, 4000
#: Bytes of a slice; Spark gives workers 10,000 rows at once. Bytes of a document that are kept in memory.
_SLICE, _KEPT = 1 << 10, 1 << 23
_FRAME = pa.struct([("node_id", pa.int32()), ("local_name", pa.string()), ("id", pa.string()), ("name", pa.string()), ("node", pa.string())])
_ARROW = pa.schema([
    ("path", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("ordinal", pa.int32()), ("local_name", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("inner_text", pa.string()), ("xpath", pa.string()), ("ancestors", pa.list_(_FRAME)),
    ("root_local", pa.string()), ("root_name", pa.string()), ("error", pa.string()),
])
_DDL = (
    "path string, node_id int, parent_id int, depth int, ordinal int, local_name string, attrs map<string,string>, text string, inner_text string, xpath string, "
    "ancestors array<struct<node_id:int,local_name:string,id:string,name:string,node:string>>, root_local string, root_name string, error string"
)


#: Columns of an element that are made with its places, and not with what is around it.
_BRIEF = ("path", "node_id", "local_name", "attrs", "text", "error")


class Places(NamedTuple):
    """What is told of the elements around an element, by the names of columns: the name (or else the id) of the nearest with one of some tags, the node_id of the outermost."""

    nearest: dict[str, tuple[str, ...]]
    outermost: dict[str, tuple[str, ...]]


class _Open:
    __slots__ = ("node_id", "parent", "local", "attrs", "text", "inner", "xpath", "ordinal", "seen", "children", "around", "below")


class Shredder:
    """Rows of one document; `take` empties what has gathered. Elements of one parent share what is told of those around them."""

    def __init__(self, path: str, inner_of: frozenset[str], places: Places | None = None):
        self.path, self.inner_of, self.brief, self.rows, self.stack, self.count = path, inner_of, places is not None, [], [], 0
        tags = [*places.nearest.values(), *places.outermost.values()] if places else []
        self.first = len(places.nearest) if places else 0
        self.marks = {tag: [i for i, own in enumerate(tags) if tag in own] for own in tags for tag in own}
        self.nowhere = (None,) * len(tags)
        self.root = ("", None)
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._start, self._end, self._say

    def _start(self, qname: str, attrs: dict[str, str]) -> None:
        e, up = _Open(), self.stack[-1] if self.stack else None
        e.local = qname.rsplit(":", 1)[-1]
        e.node_id, e.parent, e.attrs, e.text, e.seen, e.children = self.count, up.node_id if up else -1, attrs, [], {}, 0
        self.count += 1
        e.inner = [] if e.local in self.inner_of else None
        n = 1
        if up:
            n = up.seen[e.local] = up.seen.get(e.local, 0) + 1
            up.children += 1
        else:
            self.root = (e.local, attrs.get("name") if e.local == "ColumnView" else attrs.get("id"))
        e.ordinal = up.children - 1 if up else 0
        e.around = up.below if up else self.nowhere
        if self.brief:
            e.xpath, e.below = None, self._below(e) if e.local in self.marks else e.around
        else:
            e.xpath = f"{up.xpath if up else ''}/{e.local}[{n}]"
            e.below = (*e.around, {"node_id": e.node_id, "local_name": e.local, "id": attrs.get("id"), "name": attrs.get("name"), "node": attrs.get("node")})
        self.stack.append(e)

    def _below(self, e: _Open) -> tuple:
        below = list(e.around)
        for i in self.marks[e.local]:
            if i < self.first:
                below[i] = e.attrs.get("name", e.attrs.get("id"))
            elif below[i] is None:
                below[i] = e.node_id
        return tuple(below)

    def _say(self, data: str) -> None:
        if self.stack:
            top = self.stack[-1]
            if not top.children:
                top.text.append(data)
            for e in self.stack if self.inner_of else ():
                if e.inner is not None:
                    e.inner.append(data)

    def _end(self, qname: str) -> None:
        e = self.stack.pop()
        inner = None if e.inner is None else "".join(e.inner).strip()
        self.rows.append((self.path, e.node_id, e.parent, len(self.stack), e.ordinal, e.local, e.attrs, "".join(e.text).strip(), inner, e.xpath, e.around, *self.root, None))

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _flaw(document) -> str | None:
    parser = expat.ParserCreate()
    try:
        while data := document.read(_PIECE):
            parser.Parse(data, False)
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        return str(e)
    finally:
        document.seek(0)
    return None


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![^>]*>|<(/?)([A-Za-z_][\w.:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_PAIR = re.compile(r"([A-Za-z_][\w.:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_REFERENCE = re.compile(r"&(?:(lt|gt|amp|quot|apos)|#(\d{1,7})|#x([0-9A-Fa-f]{1,6}));")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _resolved(text: str) -> str:
    def of(m: re.Match) -> str:
        code = int(m[2]) if m[2] else int(m[3], 16) if m[3] else 0
        return _NAMED[m[1]] if m[1] else chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _REFERENCE.sub(of, text) if "&" in text else text


def recover(s: Shredder, data: bytes):
    """Feed a broken document to `s`, yielding after each end of an element."""
    text, at = data.decode("utf-8", "replace").lstrip("\ufeff"), 0
    for m in _TOKEN.finditer(text):
        s._say(_resolved(text[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            s._say(m[1])
        elif m[3] and m[2]:
            local = m[3].rsplit(":", 1)[-1]
            if any(e.local == local for e in s.stack):
                while s.stack[-1].local != local:
                    s._end("")
                s._end("")
                yield
        elif m[3] and (s.stack or not s.count):  # one root
            s._start(m[3], {k: _resolved(a or b) for k, a, b in _PAIR.findall(m[4])})
            if m[5]:
                s._end("")
                yield
    s._say(_resolved(text[at:]))
    while s.stack:
        s._end("")
        yield


def _mapped(column: list[dict], kind: pa.DataType) -> pa.Array:
    ends = pa.array([0, *accumulate(map(len, column))], pa.int32())
    return pa.MapArray.from_arrays(ends, pa.array([k for a in column for k in a], kind.key_type), pa.array([v for a in column for v in a.values()], kind.item_type))


def _shared(column: list[tuple]) -> tuple[list[tuple], pa.Array]:
    """The different objects of a column and where each row has its own."""
    at: dict[int, int] = {}
    where = pa.array([at.setdefault(id(t), len(at)) for t in column], pa.int32())
    by_id = {id(t): t for t in column}
    return [by_id[i] for i in at], where


def _batch(rows: list[tuple], schema: pa.Schema = _ARROW, places: Places | None = None) -> pa.RecordBatch:
    columns = dict(zip(_ARROW.names, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(_ARROW.names, ())
    found = []
    around, where = _shared(columns["ancestors"])
    for field in schema:
        if field.name == "attrs":
            found.append(_mapped(columns["attrs"], field.type))
        elif field.name == "ancestors":
            found.append(pa.array([list(t) for t in around], field.type).take(where))
        elif field.name in columns:
            found.append(pa.array(columns[field.name], field.type))
        else:
            i = [*places.nearest, *places.outermost].index(field.name)
            found.append(pa.array([t[i] if t else None for t in around], field.type).take(where))
    return pa.RecordBatch.from_arrays(found, schema=schema)


def _rows_of(path: str, document, inner: frozenset[str], places: Places | None = None):
    """Rows of a document, a file of bytes, some at a time."""
    s = Shredder(path, inner, places)
    data, flaw = document.read(_PIECE + 1), None
    if len(data) <= _PIECE:  # one piece is checked as it is read
        try:
            s.parser.Parse(data, False)
            s.parser.Parse(b"", True)
        except expat.ExpatError as e:
            s, flaw = Shredder(path, inner, places), str(e)
        else:
            yield s.take()
            return
    document.seek(0)
    if flaw is not None or (flaw := _flaw(document)) is not None:
        yield [(path, -1, -1, 0, 0, None, {}, None, None, None, (), None, None, flaw)]
        for _ in recover(s, document.read()):
            yield s.take()
        return
    while data := document.read(_PIECE):
        s.parser.Parse(data, False)
        yield s.take()
    s.parser.Parse(b"", True)
    yield s.take()


def shred(documents: DataFrame, inner_of: tuple[str, ...] = ("filter",), places: Places | None = None) -> DataFrame:
    """Elements of (path, content) rows, and one row with an error for each document that can't be read.

    With `places`, rows are brief: these columns stand for the ancestors, and no place of the element itself is told.
    """
    inner = frozenset(inner_of)
    schema, ddl = _ARROW, _DDL
    if places is not None:
        kinds = {**dict.fromkeys(places.nearest, pa.string()), **dict.fromkeys(places.outermost, pa.int32())}
        schema = pa.schema([*[_ARROW.field(c) for c in _BRIEF], *kinds.items()])
        ddl = ", ".join(["path string, node_id int, local_name string, attrs map<string,string>, text string, error string", *[f"{c} {'string' if c in places.nearest else 'int'}" for c in kinds]])

    def run(batches):
        rows: list[tuple] = []
        now = None
        for batch in batches:
            for path, data, last in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                now = now or tempfile.SpooledTemporaryFile(_KEPT)
                now.write(data.as_py())
                if not last.as_py():
                    continue
                now.seek(0)
                for some in _rows_of(path.as_py(), now, inner, places):
                    rows += some
                    while len(rows) >= _ROWS:
                        yield _batch(rows[:_ROWS], schema, places)
                        rows = rows[_ROWS:]
                now.close()
                now = None
        if rows:
            yield _batch(rows, schema, places)

    def slices(content):
        last = F.greatest(F.floor((F.length(content) - 1) / _SLICE).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(content.substr(i * _SLICE + 1, F.lit(_SLICE)).alias("data"), (i == last).alias("last")))

    # an argument of a function is made once, while a column may be made again for each slice
    cut = F.transform(F.array(F.coalesce("content", F.lit(b""))), slices)[0]
    return documents.select("path", F.explode(cut).alias("s")).select("path", "s.data", "s.last").mapInArrow(run, ddl)


def profile() -> F.Column:
    """CV, ANV, DIM or ATV by the root's name, else null (SRC3)."""
    root = F.col("root_local")
    return F.when(root.isin("scenario", "calculationView"), "CV").when(root == "cube", "ANV").when(root == "dimension", "DIM").when(root == "ColumnView", "ATV")


def elements(shredded: DataFrame) -> DataFrame:
    """Elements of documents with a known profile."""
    return shredded.filter("error IS NULL").withColumn("profile", profile()).filter("profile IS NOT NULL")


def bad_documents(shredded: DataFrame) -> DataFrame:
    """(path, reason) of documents that are broken, though elements may have been recovered, and of those with another root."""
    broken = shredded.filter("error IS NOT NULL").select("path", F.col("error").alias("reason"))
    other = shredded.filter(F.col("error").isNull() & (F.col("depth") == 0) & profile().isNull()).join(broken.select("path"), "path", "left_anti").select("path", F.concat(F.lit("root "), "root_local").alias("reason"))
    return broken.unionByName(other)
