"""Deeply nested records to related flat tables (problem 3).

A bottom-up tree automaton runs inside the JSON reader: whenever an object closes,
its state is looked up from the set of (key, state of the child) pairs alone. A
state is a set of the roles that a value of this shape can play: tag pair, tag
map, reference, point, member, element of a known or of a still unknown type, or
an envelope with elements somewhere below. The keys that matter and the states
are finite, so the table of transitions stays small however many tags or layouts
a corpus has.

The states then route: only envelopes that hold elements are entered, and each
child of an element goes to the typed subtype table of its role (tag, node,
member, point), all of which keep the supertype key ``(response_id, el_type,
el_id)`` and the ordinal of the parent.

Defined cases: null and cut-off bodies, and bodies that are not strict JSON
(``NaN`` included), give no rows, nor does one nested deeper than the JSON reader
can go (thousands of levels); a body that is a JSON string is read again as JSON,
however often; null tag values and null refs are no children; a single object
stands for a list of one; an element without type or usable id has no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframe.session import materialize

# roles of a value; a state is a set of them
NULL, INTEGER, TEXT, KIND_NODE, KIND_WAY, KIND_RELATION = (1 << i for i in range(6))
PAIR, TAG_MAP, REF, POINT, MEMBER, TRACK = (1 << i for i in range(6, 12))
NODE, WAY, RELATION, UNTYPED, FOREIGN, HOLDER = (1 << i for i in range(12, 18))
LIST, OBJECT = 1 << 18, 1 << 19
SCALAR = NULL | INTEGER | TEXT | KIND_NODE | KIND_WAY | KIND_RELATION

ELEMENT_TYPES = {"node": NODE, "way": WAY, "relation": RELATION}
_KINDS = {"node": KIND_NODE, "way": KIND_WAY, "relation": KIND_RELATION}
#: Keys that transitions tell apart, with or without the attribute sign; all others are one letter of the alphabet.
_LABELS = {f"{sign}{k}": k for sign in ("", "@") for k in ("id", "type", "ref", "k", "v", "lat", "lon", "geometry", "nd", "node", "way", "relation")}
_TYPE_KEY, _ID_KEY, _REF_KEY, _ROLE_KEY = ("type", "@type"), ("id", "@id"), ("ref", "@ref"), ("role", "@role")
_NUMBER_START = frozenset("0123456789+- \t\n")
_INTEGER = re.compile(r"\s*[+-]?[0-9]{1,19}\s*", re.ASCII)

FLAT = ("response_id bigint, el_ord int, el_type string, el_id bigint, kind string, pos int, sub_pos int, "
        "tag_key string, tag_value string, ref bigint, ref_type string, role string, lat double, lon double")


class Record(dict):
    """A JSON object with the state that the automaton gave it."""

    __slots__ = ("state",)


class TreeAutomaton:
    """Bottom-up: states of the children decide the state of their parent."""

    def __init__(self) -> None:
        self.table: dict[frozenset, int] = {}
        self.decoder = json.JSONDecoder(object_pairs_hook=self._close, parse_constant=_refuse)

    def read(self, text: str) -> Any:
        """The value of a JSON text, its objects with states; raises ``ValueError`` where it is not strict JSON."""
        value = self.decoder.decode(text)
        while isinstance(value, str):
            value = self.decoder.decode(value)
        return value

    def state(self, value: Any) -> int:
        kind = type(value)
        if kind is str:
            named = _KINDS.get(value)
            if named is not None:
                return named | TEXT
            return INTEGER if value[:1] in _NUMBER_START and _integer(value) is not None else TEXT
        if kind is Record:
            return value.state
        if kind is list:
            out = LIST
            for item in value:
                out |= self.state(item)
            return out
        if value is None:
            return NULL
        return INTEGER if _integer(value) is not None else TEXT

    def _close(self, pairs: list[tuple[str, Any]]) -> Record:
        record = Record(pairs)
        state, label = self.state, _LABELS.get
        shape = frozenset([(label(key, ""), state(value)) for key, value in record.items()])
        found = self.table.get(shape)
        if found is None:
            found = self.table[shape] = transition(shape)
        record.state = found
        return record


def transition(shape: frozenset) -> int:
    """The state of an object from the (label, state) pairs of its children."""
    under: dict[str, int] = {}
    state = OBJECT
    plain = True
    for label, child in shape:
        under[label] = under.get(label, 0) | child
        plain &= not child & OBJECT or (child & (TAG_MAP | LIST)) == TAG_MAP
        if child & (NODE | WAY | RELATION | HOLDER) or (label in ELEMENT_TYPES and child & UNTYPED):
            state |= HOLDER
    if plain:
        state |= TAG_MAP
    if set(under) == {"k", "v"} and under["k"] & SCALAR:
        state |= PAIR
    if "lat" in under and "lon" in under:
        state |= POINT
    if under.get("ref", 0) & INTEGER:
        state |= REF | (MEMBER if "type" in under else 0)
    if (under.get("geometry", 0) | under.get("nd", 0)) & POINT:
        state |= TRACK
    if "id" in under:
        kind = under.get("type", NULL)
        state |= (NODE if kind & KIND_NODE else WAY if kind & KIND_WAY else RELATION if kind & KIND_RELATION
                  else UNTYPED if kind & NULL else FOREIGN)
    return state


def _refuse(name: str) -> Any:
    raise ValueError(name)


def _many(value: Any) -> list:
    """Single-or-list: null gives none, anything but a list counts as one."""
    return [] if value is None else value if isinstance(value, list) else [value]


def _first(record: dict, names: tuple[str, ...]) -> Any:
    for name in names:
        if record.get(name) is not None:
            return record[name]
    return None


def _integer(value: Any) -> int | None:
    """A 64-bit id from a number or its text; null when it is neither."""
    if type(value) is int:
        return value if -(1 << 63) <= value < 1 << 63 else None
    if isinstance(value, str):
        if not _INTEGER.fullmatch(value):
            return None
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value in (float("inf"), -float("inf")):
        return None
    number = int(value)
    return number if number == value and -(1 << 63) <= number < 1 << 63 else None


def _double(value: Any) -> float | None:
    try:
        return None if value is None or isinstance(value, bool) else float(value)
    except (ValueError, TypeError, OverflowError):
        return None


def _text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _elements(value: Any) -> Iterator[tuple[str, Record]]:
    """Elements below a value, in document order, without recursion; values whose state holds none are never entered."""
    stack: list[tuple[Any, str | None]] = [(value, None)]
    while stack:
        node, under = stack.pop()
        if isinstance(node, list):
            stack += [(x, under) for x in reversed(node) if isinstance(x, (list, Record))]
        elif isinstance(node, Record):
            state = node.state
            kind = next((k for k, bit in ELEMENT_TYPES.items() if state & bit), under if state & UNTYPED and under in ELEMENT_TYPES else None)
            if kind is not None:
                yield kind, node
            elif state & HOLDER and not state & FOREIGN:
                stack += [(x, k) for k, x in reversed(node.items()) if isinstance(x, (list, Record))]


def _tags(record: Record) -> Iterator[tuple[str, str]]:
    """Subtype *tag*: from pairs, or from a (nested) map with its keys joined by ``:``."""
    for source in ("tags", "tag"):
        value = record.get(source)
        for group in _many(value):
            if not isinstance(group, Record):
                continue
            if group.state & PAIR and (source == "tag" or isinstance(value, list)):
                key, single = _first(group, ("@k", "k")), _first(group, ("@v", "v"))
                if key is not None and single is not None:
                    yield _text(key), _text(single)
                continue
            stack = [(k, v) for k, v in reversed(group.items())]
            while stack:
                key, value_ = stack.pop()
                if isinstance(value_, Record):
                    stack += [(f"{key}:{k}", v) for k, v in reversed(value_.items())]
                else:
                    for single in _many(value_):
                        if single is not None:
                            yield key, _text(single)


def _ref(entry: Any) -> int | None:
    if isinstance(entry, Record):
        return _integer(_first(entry, _REF_KEY)) if entry.state & REF else None
    return _integer(entry)


def flat_children(body: str, automaton: TreeAutomaton) -> Iterator[tuple]:
    """Rows of ``FLAT`` without the response: every child of every element of one body."""
    try:
        value = automaton.read(body)
    except (ValueError, RecursionError):
        return
    for ordinal, (kind, record) in enumerate(_elements(value)):
        el_id = _integer(_first(record, _ID_KEY))
        if el_id is None:
            continue
        parent = (ordinal, kind, el_id)
        for key, text in _tags(record):
            yield *parent, "tag", 0, 0, key, text, None, None, None, None, None
        if kind == "way":  # the place in the way counts every entry, also one without a usable ref
            for pos, entry in enumerate(_many(record.get("nodes")) or _many(record.get("nd")), 1):
                ref = _ref(entry)
                if ref is not None:
                    yield *parent, "node", pos, 0, None, None, ref, "node", None, None, None
        elif kind == "relation":
            for pos, member in enumerate(_many(record.get("members")) or _many(record.get("member")), 1):
                if not isinstance(member, Record):
                    continue
                if member.state & REF:
                    m_type, role = _first(member, _TYPE_KEY) if member.state & MEMBER else None, _first(member, _ROLE_KEY)
                    yield (*parent, "member", pos, 0, None, None, _ref(member), "" if m_type is None else str(m_type), "" if role is None else str(role),
                           None, None)
                if member.state & TRACK:
                    for sub, point in enumerate(_many(member.get("geometry")) or _many(member.get("nd")), 1):
                        if isinstance(point, Record) and point.state & POINT:
                            yield (*parent, "point", pos, sub, None, None, None, None, None, _double(_first(point, ("lat", "@lat"))),
                                   _double(_first(point, ("lon", "@lon"))))


def nested_children(raw: DataFrame, id_column: str = "response_id", body_column: str = "body") -> DataFrame:
    """All subtype tables stacked (``FLAT``), with ``el_ord`` as the link to the parent element inside its response."""
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(),
             pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in FLAT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TreeAutomaton()

        def pack(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for rid, body in zip(batch.column(0), batch.column(1)):
                text, key = body.as_py(), rid.as_py()
                if text is not None:
                    rows += [(key, *child) for child in flat_children(text, automaton)]
                if len(rows) > 50_000:
                    yield pack(rows)
                    rows = []
            yield pack(rows)

    return raw.select(F.col(id_column).cast("bigint"), F.col(body_column)).mapInArrow(run, FLAT)


def nested_found(raw: DataFrame) -> DataFrame:
    """Distinct children without the ordinal, each as one text item."""
    kind = F.col("kind")
    item = (F.when(kind == "tag", F.concat_ws("=", "tag_key", "tag_value")).when(kind == "node", F.col("ref").cast("string"))
            .when(kind == "member", F.concat_ws("/", "ref_type", F.col("ref").cast("string"), "role")).otherwise(""))
    return nested_children(raw).select("response_id", "el_type", "el_id", "kind", "pos", "sub_pos", item.alias("item")).distinct()


_PARENT = ["response_id", "el_ord", "el_type", "el_id"]
#: Columns of each typed subtype table after the supertype key.
SUBTYPES = {"tag": ["tag_key", "tag_value"], "node": ["pos", "ref"], "member": ["pos", "ref_type", "ref", "role"], "point": ["pos", "sub_pos", "lat", "lon"]}


def nested_table(raw: DataFrame, kind: str) -> DataFrame:
    """One typed subtype table; each row links to its element by ``(response_id, el_ord)``, whose type and id it repeats."""
    return nested_children(raw).where(F.col("kind") == kind).select(*_PARENT, *SUBTYPES[kind])


def nested_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """All typed subtype tables from one reading of the bodies."""
    rows = materialize(nested_children(raw), "children")
    return {kind: rows.where(F.col("kind") == kind).select(*_PARENT, *columns) for kind, columns in SUBTYPES.items()}


def element_table(elements: DataFrame, kind: str) -> DataFrame:
    """The same subtype tables from the typed columns of element rows, linked by ``(el_type, el_id, version, extract_id)``."""
    parent = [F.col("type").alias("el_type"), F.col("id").alias("el_id"), "version", "extract_id"]
    if kind == "tag":
        return elements.select(*parent, F.explode("tags").alias("tag_key", "tag_value")).where("tag_value IS NOT NULL")
    if kind == "node":
        rows = elements.where("type = 'way'").select(*parent, F.posexplode("nodes").alias("_p", "ref"))
        return rows.where("ref IS NOT NULL").select("el_type", "el_id", "version", "extract_id", (F.col("_p") + 1).alias("pos"), "ref")
    if kind == "member":
        rows = elements.where("type = 'relation'").select(*parent, F.posexplode("members").alias("_p", "m")).where("m.ref IS NOT NULL")
        return rows.select("el_type", "el_id", "version", "extract_id", (F.col("_p") + 1).alias("pos"), F.coalesce("m.type", F.lit("")).alias("ref_type"),
                           F.col("m.ref").alias("ref"), F.coalesce("m.role", F.lit("")).alias("role"))
    raise ValueError(f"element rows have no {kind} table")
