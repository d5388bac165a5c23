"""Nested annotation records to flat, linked tables, by Arrow list offsets and parent indices.

A batch of payloads becomes one table of JSON nodes (json_nodes), read off the Arrow buffer without parsing rows. What a node
is (a document, an event, a container's child, a referent) follows from the keys on its way up, for all nodes at once by
pointer doubling. Nodes of one kind, in order of their parents, are the values of list arrays whose offsets are the counts
per parent; each table is made by flattening these lists, and the keys of the level above follow by one vectorised take()
with the parent index of every child.

Defined results: a null, empty or broken payload gives no rows (NaN and Infinity are broken, nesting has no limit); a
document without doc_uid keeps its rows with a null doc_uid; an id that is 0, blank, no whole number or beyond bigint is null;
of equal names in one object, without regard to case, "_" and "-", the last counts; a JSON text inside a field that is not a
plain text counts as what it holds, a broken one as nothing; half of a surrogate pair is U+FFFD; events inside events are
events of the same document with parent_event_no set; what lies under an event's earlier versions is skipped; a document
delivered again gives its rows again (callers that want a set use distinct()); columns of the input other than the two named
ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import json_nodes as jn

LAYERS = {"participants": "participant", "fillers": "filler", "discontiguous": "discontiguous", "discontiguoustriggers": "discontiguous"}
INSIDE = ("coordination", "events", "subevents")
TEXTS = ("text", "role", "type", "subtype", "modality", "negation", "documenttitle", "id", "docuid", "elementid", "linkid", "pronomid", "referentid")  # never opened as JSON

REFERENT = pa.struct([("pronom_id", pa.int64()), ("referent_id", pa.int64())])
SPAN = [("begin_pos", pa.int32()), ("end_pos", pa.int32()), ("text", pa.string())]
CHILD = pa.struct([("layer", pa.string()), ("link_id", pa.int64()), ("element_id", pa.int64()), ("role", pa.string()), *SPAN, ("referents", pa.list_(REFERENT))])
EVENT = pa.struct(
    [("event_no", pa.int32()), ("parent_event_no", pa.int32()), ("event_id", pa.int64()), ("event_type", pa.string()), ("event_subtype", pa.string()), ("polarity_negation", pa.string()), ("modality", pa.string()), *SPAN, ("children", pa.list_(CHILD))]
)
DOCUMENT = pa.struct([("doc_uid", pa.int64()), ("document_title", pa.string()), ("annotator_id", pa.string()), ("events", pa.list_(EVENT))])

_KEYS = {0: [("record_id", pa.int64())], 1: [("record_id", pa.int64()), ("doc_uid", pa.int64())], 2: [("record_id", pa.int64()), ("doc_uid", pa.int64()), ("event_no", pa.int32()), ("event_id", pa.int64())]}
_KEYS[3] = [*_KEYS[2], ("layer", pa.string()), ("link_id", pa.int64()), ("element_id", pa.int64())]


def _plain(struct: pa.StructType, skip: set[str]) -> list[tuple[str, pa.DataType]]:
    return [(f.name, f.type) for f in struct if not pa.types.is_list(f.type) and f.name not in skip]


TABLES = {
    "documents": pa.schema([*_KEYS[0], *_plain(DOCUMENT, set())]),
    "events": pa.schema([*_KEYS[1], *_plain(EVENT, set())]),
    "children": pa.schema([*_KEYS[2], *_plain(CHILD, set())]),
    "referents": pa.schema([*_KEYS[3], *_plain(REFERENT, set())]),
}

BATCH_BYTES = 1 << 20


class Tree:
    """The nodes of a batch with JSON texts inside fields opened in place, and what each node is."""

    def __init__(self, payloads: pa.Array) -> None:
        first = jn.parse(payloads)
        self.sources = [first]
        self.row, self.parent, self.kind = first.row, first.parent, first.kind
        self.source, self.at = np.zeros(len(first.row), np.int64), np.arange(len(first.row))
        self.names: dict[str, int] = {}
        self.key = self._keys(first)
        self.rank = np.arange(len(first.row))
        fresh = self.at
        while len(fresh := self._sealed(fresh)):
            fresh = self._open(fresh)

    def _keys(self, nodes: jn.Nodes) -> np.ndarray:
        """Keys without "_", "-" and case, as codes all sources share."""
        raw = nodes.names
        plain = pc.utf8_lower(pc.replace_substring_regex(raw, "[_-]", ""))
        self.map_key = getattr(self, "map_key", {})
        codes = np.fromiter((self.names.setdefault(x, len(self.names)) for x in plain.to_pylist()), np.int64, len(plain))
        for code, text, is_id in zip(codes, raw.to_pylist(), pc.match_substring_regex(raw, r"^_?\d+$").to_pylist()):
            if is_id:
                # A map's key: "_12" names no link, "12" does; both have their own code, as the mark counts.
                self.map_key[text] = self.names.setdefault(f"#{text}", len(self.names))
        remap = np.array([self.map_key.get(t, c) for t, c in zip(raw.to_pylist(), codes)], np.int64)
        return np.where(nodes.key >= 0, remap[nodes.key], -1) if len(remap) else nodes.key

    def code(self, name: str) -> int:
        return self.names.get(name, -2)

    def _sealed(self, among: np.ndarray) -> np.ndarray:
        """Text nodes that may hold JSON."""
        plain = np.isin(self.key[among], [self.code(t) for t in TEXTS])
        texts = among[(self.kind[among] == jn.STRING) & ~plain]
        held = self.strings(texts, raw=True)
        return texts[pc.match_substring_regex(held, r"^[\[{]").to_numpy(zero_copy_only=False)]

    def _open(self, hosts: np.ndarray) -> np.ndarray:
        """Replaces the hosts by what they hold; gives the new nodes."""
        inner = jn.parse(self.strings(hosts))
        key = self._keys(inner)
        roots = np.flatnonzero(inner.parent < 0)
        self.kind[hosts] = jn.SCALAR  # a broken one is nothing
        n = len(self.row)
        number = np.arange(len(inner.row)) + n
        number[roots] = hosts[inner.row[roots]]
        self.kind[number[roots]] = inner.kind[roots]
        below = np.flatnonzero(inner.parent >= 0)
        place = np.empty(len(inner.row), np.int64)
        place[below] = n + np.arange(len(below))
        place[roots] = number[roots]
        self.sources.append(inner)
        self.row = np.r_[self.row, self.row[hosts[inner.row[below]]]]
        self.parent = np.r_[self.parent, place[inner.parent[below]]]
        self.kind = np.r_[self.kind, inner.kind[below]]
        self.key = np.r_[self.key, key[below]]
        self.source = np.r_[self.source, np.full(len(below), len(self.sources) - 1)]
        self.at = np.r_[self.at, below]
        order = np.lexsort((np.r_[np.full(n, -1), below], np.r_[self.rank, self.rank[hosts[inner.row[below]]]]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        return np.arange(n, len(self.row))

    def strings(self, nodes: np.ndarray, raw: bool = False) -> pa.LargeStringArray:
        """What stands at the nodes, texts without their escapes unless raw."""
        parts, order = [], np.empty(len(nodes), np.int64)
        done = 0
        for i, source in enumerate(self.sources):
            own = np.flatnonzero(self.source[nodes] == i)
            if len(own):
                sort = own[np.argsort(self.at[nodes[own]], kind="stable")]
                at, repeat = np.unique(self.at[nodes[sort]], return_inverse=True)
                parts.append(source.slices(at).take(pa.array(repeat)))
                order[sort] = done + np.arange(len(sort))
                done += len(sort)
        joint = pa.concat_arrays(parts).take(pa.array(order)) if parts else pa.array([], pa.large_string())
        return joint if raw else jn.unescaped(joint)

    # Lookups -------------------------------------------------------------------------------------------------------

    def value(self, owners: np.ndarray, name: str) -> np.ndarray:
        """The node of owners' field `name`, -1 where there is none; of equal names the last. -1 owns nothing."""
        found = self._fields.get(name)
        if found is None:
            found = self._fields[name] = np.full(len(self.row) + 1, -1)
            own = np.flatnonzero(self.key == self.code(name))
            own = own[np.argsort(self.rank[own], kind="stable")]
            found[self.parent[own]] = own
            found[-1] = -1
        return found[owners]

    @cached_property
    def _fields(self) -> dict[str, np.ndarray]:
        return {}

    def inner(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes that are objects, else -1."""
        return np.where((nodes >= 0) & (self.kind[nodes] == jn.OBJECT), nodes, -1)

    def text(self, nodes: np.ndarray) -> pa.Array:
        """Text nodes as text, others as null."""
        return self._column(nodes, self.kind[nodes] == jn.STRING, pa.string(), lambda n: self.strings(n).cast(pa.string()))

    def _column(self, nodes: np.ndarray, ok: np.ndarray, kind: pa.DataType, make) -> pa.Array:
        at = np.flatnonzero((nodes >= 0) & ok)
        place = np.full(len(nodes), -1)
        place[at] = np.arange(len(at))
        return make(nodes[at]).take(pa.array(place, mask=place < 0)) if len(at) else pa.nulls(len(nodes), kind)

    def whole(self, nodes: np.ndarray, least: int, most: int, kind: pa.DataType, fractions: bool) -> pa.Array:
        """Whole numbers in least..most, written as a number or a text; null for all else."""

        def make(own: np.ndarray) -> pa.Array:
            raw = self.strings(own)
            quoted = pa.array(self.kind[own] == jn.STRING)
            digits = pc.replace_substring_regex(raw, r"^\s*\+?0*(\d+)\s*$", r"\1")
            digits = pc.if_else(quoted, digits, pc.replace_substring_regex(raw, r"^(-?)0*(\d+)$", r"\1\2"))
            if fractions:
                odd = pc.and_(pc.invert(quoted), pc.match_substring_regex(raw, r"^\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"))
                odd = pc.and_(odd, pc.match_substring_regex(raw, r"[.eE]"))
                if pc.any(odd).as_py():
                    number = pc.if_else(odd, raw, None).cast(pa.float64())
                    fit = pc.and_(pc.equal(number, pc.floor(number)), pc.less(number, 2.0**63))
                    digits = pc.if_else(pc.fill_null(fit, False), pc.if_else(fit, number, None).cast(pa.int64(), safe=False).cast(pa.large_string()), pc.if_else(odd, None, digits))
            fine = pc.match_substring_regex(digits, r"^-?\d{1,19}$")
            wide = pc.if_else(pc.and_(fine, pc.invert(pc.and_(quoted, pc.starts_with(digits, "-")))), digits, None).cast(pa.decimal128(19, 0))
            inside = pc.and_(pc.greater_equal(wide, pa.scalar(least, pa.int64()).cast(pa.decimal128(19, 0))), pc.less_equal(wide, pa.scalar(most, pa.int64()).cast(pa.decimal128(19, 0))))
            return pc.if_else(inside, wide, None).cast(kind)

        return self._column(nodes, (self.kind[nodes] == jn.STRING) | (self.kind[nodes] == jn.SCALAR), kind, make)

    def id(self, nodes: np.ndarray) -> pa.Array:
        return self.whole(nodes, 1, (1 << 63) - 1, pa.int64(), True)

    def place(self, nodes: np.ndarray) -> pa.Array:
        return self.whole(nodes, -(1 << 31), (1 << 31) - 1, pa.int32(), False)

    # What a node is --------------------------------------------------------------------------------------------------

    @cached_property
    def top(self) -> np.ndarray:
        """Each node's outermost array that stands directly under an object or at the root; itself if it is in no array."""
        up = np.where((self.parent >= 0) & (self.kind[self.parent] == jn.ARRAY), self.parent, np.arange(len(self.row)))
        while np.any((further := up[up]) != up):
            up = further
        return up

    @cached_property
    def objects(self) -> np.ndarray:
        own = np.flatnonzero(self.kind == jn.OBJECT)
        return own[np.argsort(self.rank[own], kind="stable")]

    def chain(self, step: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """Where each node's way along step ends, moving on from nodes that go on."""
        to = np.where(goes_on, step, np.arange(len(step)))
        while np.any((further := to[to]) != to):
            to = further
        return to

    @cached_property
    def holder(self) -> np.ndarray:
        """The nearest object above, -1 for none."""
        return self.parent[self.top]

    @cached_property
    def documents(self) -> np.ndarray:
        """The outermost objects with a doc_uid or events."""
        has = (self.value(self.objects, "docuid") >= 0) | (self.value(self.objects, "events") >= 0)
        named = self.objects[has]
        marked = np.zeros(len(self.row), bool)
        marked[named] = True
        # The way up from each node's parent to the next marked object, or to a root.
        stop = self.chain(np.maximum(self.parent, 0), (self.parent >= 0) & ~marked)
        above = np.where(self.parent[named] >= 0, stop[self.parent[named]], -1)
        return named[(above < 0) | ~marked[above]]

    @cached_property
    def states(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each node whether it is an event (1), in a document outside events (0) or neither (2), and its document.

        A key is a function of states: composed along the ways up, in as many steps as the depth has binary digits.
        """
        n = len(self.row)
        objects = self.objects
        key = self.key[self.top]
        move = np.tile(np.array([0, 2, 2]), (n, 1))  # outside events go on, inside events end
        move[key == self.code("events"), 0] = 1
        move[np.isin(key, [self.code(k) for k in INSIDE]), 1] = 1
        move[key == self.code("metadata"), 0] = 2
        up = self.holder.copy()
        move[up < 0] = 2
        is_doc = np.zeros(n, bool)
        is_doc[self.documents] = True
        move[is_doc] = 0
        up[is_doc] = -1
        of = objects
        move, up = move[of], up[of]
        place = np.full(n + 1, -1)
        place[of] = np.arange(len(of))
        up = place[up]
        root = np.where(is_doc[of], of, -1)
        while np.any(up >= 0):
            go = np.flatnonzero(up >= 0)
            move[go] = np.take_along_axis(move[go], move[up[go]], 1)
            root[go] = root[up[go]]
            up[go] = up[up[go]]
        state, document = np.full(n, 2), np.full(n, -1)
        state[of], document[of] = move[:, 0], root
        return state, document

    @cached_property
    def events(self) -> np.ndarray:
        state, document = self.states
        own = self.objects
        return own[(state[own] == 1) & (document[own] >= 0)]

    @cached_property
    def children(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(child, its event, the container's key) for the shapes of a container: nothing, a list (of lists), one child, a counted list, a map by link id."""
        n = len(self.row)
        is_event = np.zeros(n + 1, bool)
        is_event[self.events] = True
        parent = self.parent
        arguments = (self.key == self.code("args")) & (self.kind == jn.OBJECT) & is_event[parent]
        event_of = np.where(is_event[parent], parent, -1)
        held = np.r_[arguments, False][parent]
        event_of[held] = parent[parent[held]]
        layers = [self.code(k) for k in LAYERS]
        container = np.isin(self.key, layers) & (event_of >= 0)
        for name in LAYERS:  # of equal names only the last stands
            own = np.flatnonzero(container & (self.key == self.code(name)))
            container[own] = self.value(parent[own], name) == own
        has_items = self.value(np.arange(n), "items") >= 0
        size = np.bincount(parent[parent >= 0], minlength=n)[:n] if n else np.empty(0, int)
        ids = np.isin(self.key, list(self.map_key.values()))
        id_keys = np.bincount(parent[(parent >= 0) & ids], minlength=n)[:n] if n else np.empty(0, int)
        shape = self.kind == jn.OBJECT
        counted, mapped = shape & has_items, shape & ~has_items & (size > 0) & (id_keys == size)
        top, holder = self.top, self.holder
        # An object is reached from the object around it, if that is counted (by "items") or a map, up to a container.
        inside = np.r_[counted, False][holder] & (self.key[top] == self.code("items")) | np.r_[mapped, False][holder]
        end = self.chain(np.maximum(holder, 0), shape & inside & ~np.r_[container][top]) if n else top
        own = self.objects
        reached = container[top[end[own]]]
        child = own[reached & ~counted[own] & ~mapped[own] & (size[own] > 0)]
        box = top[end[child]]
        return child, event_of[box], self.key[box]

    def links(self, child: np.ndarray) -> pa.Array:
        """A child's own link id, else the key of the map it stands in directly."""
        own = self.id(self.value(child, "linkid"))
        text = {c: int(t) for t, c in self.map_key.items() if t[0] != "_" and 0 < int(t) < 1 << 63}
        keys, back = np.unique(self.key[child], return_inverse=True) if len(child) else (np.empty(0, int), np.empty(0, int))
        named = pa.array([text.get(int(k)) for k in keys], pa.int64()).take(pa.array(back))
        direct = (self.parent[child] >= 0) & (self.kind[self.parent[child]] == jn.OBJECT)
        return pc.coalesce(own, pc.if_else(pa.array(direct), named, None))


def _lists(parents: np.ndarray, owners: np.ndarray, fields: dict[str, pa.Array]) -> pa.ListArray:
    """One list for each owner: the fields' rows, which stand in any order, by their parent."""
    place = np.full((max(owners.max(initial=-1), parents.max(initial=-1)) + 2), -1)
    place[owners] = np.arange(len(owners))
    at = place[parents]
    order = pa.array(np.argsort(at, kind="stable"))
    offsets = np.r_[0, np.cumsum(np.bincount(at, minlength=len(owners)))].astype(np.int32)
    values = pa.StructArray.from_arrays([v.take(order) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def decode(payloads: pa.Array, table: str | None = None) -> pa.ListArray:
    """The typed nested array, one list of documents for each payload; only what `table` needs where one is named."""
    tree = Tree(payloads)
    every = table is None
    documents, events = tree.documents, tree.events
    fields: dict[str, pa.Array] = {"doc_uid": tree.id(tree.value(documents, "docuid"))}
    if every or table == "documents":
        meta = tree.inner(tree.value(documents, "metadata"))
        annotator = tree.value(meta, "annotator")
        fields |= {"document_title": tree.text(tree.value(meta, "documenttitle")), "annotator_id": tree.text(np.where(tree.inner(annotator) >= 0, tree.value(tree.inner(annotator), "id"), annotator))}
    if every or table != "documents":
        fields["events"] = _lists(tree.states[1][events], documents, _events(tree, table))
    return _lists(tree.row[documents], np.arange(len(payloads)), fields)


def _span(tree: Tree, take) -> dict[str, pa.Array]:
    return {"begin_pos": tree.place(take("begin")), "end_pos": tree.place(take("end")), "text": tree.text(take("text"))}


def _events(tree: Tree, table: str | None) -> dict[str, pa.Array]:
    state, document = tree.states
    events = tree.events
    starts = np.searchsorted(np.unique(tree.rank[document[events]]), tree.rank[document[events]])  # events stand in order of their documents
    number = np.arange(len(events)) - np.r_[0, np.cumsum(np.bincount(starts))][starts] if len(events) else events
    number_of = np.full(len(tree.row) + 1, -1)
    number_of[events] = number
    above = number_of[np.where(np.r_[state, 2][tree.holder[events]] == 1, tree.holder[events], -1)]
    fields = {"event_no": pa.array(number, pa.int32()), "parent_event_no": pa.array(above, pa.int32(), mask=above < 0), "event_id": tree.id(tree.value(events, "elementid"))}
    if table in (None, "events"):
        attributes = tree.inner(tree.value(events, "attributes"))
        polarity = tree.value(attributes, "polarity")
        negation = np.where(tree.inner(polarity) >= 0, tree.value(tree.inner(polarity), "negation"), polarity)
        fields |= {"event_type": tree.text(tree.value(events, "type")), "event_subtype": tree.text(tree.value(events, "subtype")), "polarity_negation": tree.text(negation), "modality": tree.text(tree.value(attributes, "modality"))}
        fields |= _span(tree, lambda name: tree.value(events, name))
    if table != "events":
        fields["children"] = _children(tree, events, table)
    return fields


def _children(tree: Tree, events: np.ndarray, table: str | None) -> pa.ListArray:
    child, event, key = tree.children
    element = tree.inner(tree.value(child, "element"))

    def take(name: str) -> np.ndarray:
        inner = tree.value(element, name)
        return np.where(inner >= 0, inner, tree.value(child, name))

    layer = {tree.code(k): v for k, v in LAYERS.items()}
    codes, back = np.unique(key, return_inverse=True) if len(key) else (key, np.empty(0, int))
    fields = {"layer": pa.array([layer[int(c)] for c in codes], pa.string()).take(pa.array(back)), "link_id": tree.links(child), "element_id": tree.id(take("elementid"))}
    if table in (None, "children"):
        fields |= {"role": tree.text(tree.value(child, "role"))} | _span(tree, take)
    if table in (None, "referents"):
        listed = tree.value(child, "canonicalreferents")
        owner = np.full(len(tree.row) + 1, -1)
        owner[listed[listed >= 0]] = child[listed >= 0]
        own = tree.objects
        own = own[(owner[tree.parent[own]] >= 0) & (tree.kind[tree.parent[own]] == jn.ARRAY)]
        pairs = {name: tree.id(tree.value(own, name.replace("_", ""))) for name in ("pronom_id", "referent_id")}
        fields["referents"] = _lists(owner[tree.parent[own]], child, pairs)
    return _lists(event, events, fields)


def unnest(lists: pa.ListArray, keys: dict[str, pa.Array]) -> tuple[dict[str, pa.Array], dict[str, pa.Array]]:
    """One level down: the fields of the flattened values, and the parents' keys taken to them by parent index."""
    parents = pc.list_parent_indices(lists)
    values = lists.flatten()
    fields = {f.name: values.field(i) for i, f in enumerate(values.type)}
    return fields, {k: v.take(parents) for k, v in keys.items()}


def flatten_nested(record_ids: pa.Array, lists: pa.ListArray, table: str) -> pa.RecordBatch:
    """One table of decoded documents, level by level."""
    schema = TABLES[table]
    fields, keys = unnest(lists, {"record_id": record_ids.cast(pa.int64())})
    for level, down, up in (("documents", "events", ("doc_uid",)), ("events", "children", ("event_no", "event_id")), ("children", "referents", ("layer", "link_id", "element_id"))):
        if table == level:
            break
        fields, keys = unnest(fields[down], keys | {k: fields[k] for k in up})
    columns = keys | {k: v for k, v in fields.items() if not pa.types.is_list(v.type)}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of text, so that memory is bounded by that or one payload."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        part = np.cumsum(size, dtype=np.int64) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def flatten_records(df: DataFrame, table: str, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """One of the linked tables documents, events, children and referents of the records in payload_col.

    Keys: (record_id, doc_uid) of a document, event_no within its document, link_id and element_id of a child. A narrow
    stage: no shuffle, memory of BATCH_BYTES of text or one payload. For several tables of the same records see decoded_records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield flatten_nested(part.column(0), decode(part.column(1), table), table)

    return df.select(F.col(id_col).cast("long").alias("record_id"), F.col(payload_col).alias("payload")).mapInArrow(run, from_arrow_schema(TABLES[table]))


_DECODED = pa.schema([("record_id", pa.int64()), ("documents", pa.list_(DOCUMENT))])


def decoded_records(df: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """(record_id, documents): the typed nested documents of each record, to be stored once where several tables are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), decode(part.column(1)).cast(_DECODED.field(1).type)], schema=_DECODED)

    return df.select(F.col(id_col).cast("long").alias("record_id"), F.col(payload_col).alias("payload")).mapInArrow(run, from_arrow_schema(_DECODED))


def flatten_decoded(decoded: DataFrame, table: str) -> DataFrame:
    """One of the linked tables of decoded_records()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield flatten_nested(batch.column(0), batch.column(1), table)

    return decoded.select("record_id", "documents").mapInArrow(run, from_arrow_schema(TABLES[table]))
