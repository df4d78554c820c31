"""Several values packed in one text field (problem 2).

The splitter works on the bytes of a whole Arrow string column at once: masks of
quotes, brackets and delimiters, quote parity by prefix sums, child offsets from
the delimiter positions, a list array from those, and a flatten with parent
ordinals. Rows that mix both quote characters go through a scan of composed state
changes, also over whole columns. Python runs per value only for rows with a
bracket nested in an outer bracket of its own kind, whose match must be found.

Defined cases: null, blank and no-value texts have no members; empty members do
not count; repeated members stay in place; an unbalanced quote or round bracket
is ordinary text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts that stand for "no value", compared in lower case (fixed values).
NO_VALUE = ("", "null", "nan", "n/a", "na", "n.a.", "<na>", "nil", "?", "??", "-", "--", "unknown", "undefined", "missing")

_QUOTES = (0x22, 0x27)
_DELIMITERS = np.zeros(256, bool)
_DELIMITERS[[ord(c) for c in ";,|/\t\n\r"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D, 0x0B, 0x0C]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_WORD = _DIGIT.copy()
_WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
#: Full-width forms of ; , | / in UTF-8.
_WIDE = (b"\xef\xbc\x9b", b"\xef\xbc\x8c", b"\xef\xbd\x9c", b"\xef\xbc\x8f")
_UNIT_SLASH = re.compile(
    rb"(?i)(?<![a-z])(?:km|kms|mi|miles?|m|met(?:er|re)s?|kilomet(?:er|re)s?|nmi)\s?(/)\s?(?:h|hr|hrs|hour|s|sec|second)(?![a-z])")


@dataclass(frozen=True)
class Packing:
    """How one field packs its values.

    ``numbers``: values may be numbers with a decimal comma and units with a slash.
    ``ids``: values are integers, so a comma always separates, and so does a blank between two digits.
    ``real``: texts of ``NO_VALUE`` or "none" that are real values in this field.
    """

    numbers: bool = False
    ids: bool = False
    real: tuple[str, ...] = ()


OSMID = Packing(ids=True)
HIGHWAY = Packing()
MAXSPEED = Packing(numbers=True, real=("none",))
FIELDS = {"osmid": OSMID, "highway": HIGHWAY, "maxspeed": MAXSPEED}


_BRACKETS = ("[]", "{}", "()")
_QUOTED = re.compile(r"""(?<!\w)"[^"]*"(?!\w)|(?<!\w)'[^']*'(?!\w)""")


def _strip_outer(arr: pa.Array) -> pa.Array:
    """Blanks and matching outer brackets removed, however many levels there are."""
    while True:  # each round takes a level off every row; without brackets nested in their own kind there are three at most
        arr = pc.utf8_trim_whitespace(arr)
        whole = tangled = None
        for a, b in _BRACKETS:
            outer = pc.and_(pc.and_(pc.starts_with(arr, a), pc.ends_with(arr, b)), pc.greater_equal(pc.binary_length(arr), 2))
            plain = pc.match_substring_regex(arr, rf"(?s)^\{a}[^\{a}\{b}]*\{b}$")
            whole = plain if whole is None else pc.or_(whole, plain)
            rest = pc.and_not(outer, plain)
            tangled = rest if tangled is None else pc.or_(tangled, rest)
        at = np.flatnonzero(tangled.to_numpy(zero_copy_only=False))
        if len(at):
            before = [arr[int(i)].as_py() for i in at]
            after = [_peel(t) for t in before]
            arr = pc.replace_with_mask(arr, tangled, pa.array(after, pa.string()))
            whole = pc.or_(whole, pc.and_(tangled, False))
            if before == after and not pc.any(whole).as_py():
                return arr
        elif not pc.any(whole).as_py():
            return arr
        arr = pc.if_else(whole, pc.utf8_slice_codeunits(arr, 1, -1), arr)


def _peel(text: str) -> str:
    """The text without the outer brackets whose match is its last character; brackets in quotes do not count."""
    hidden = bytearray(len(text))
    for m in _QUOTED.finditer(text):
        hidden[m.start(): m.end()] = b"\1" * (m.end() - m.start())
    match: dict[int, int] = {}
    open_: dict[str, list[int]] = {a: [] for a, _ in _BRACKETS}
    ends = {b: a for a, b in _BRACKETS}
    for i, c in enumerate(text):
        if hidden[i]:
            continue
        if c in open_:
            open_[c].append(i)
        elif c in ends and open_[ends[c]]:
            match[open_[ends[c]].pop()] = i
    low, high = 0, len(text) - 1
    while low < high and match.get(low) == high:
        low, high = low + 1, high - 1
        while low <= high and text[low].isspace():
            low += 1
        while high >= low and text[high].isspace():
            high -= 1
    return text[low: high + 1]


def _bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and the n + 1 offsets into them."""
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int32)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _row_sums(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running count before each byte within its row, and the total of each row."""
    total = np.concatenate(([0], np.cumsum(mask)))
    per_row = total[offsets[1:]] - total[offsets[:-1]]
    return total[:-1] - np.repeat(total[offsets[:-1]], np.diff(offsets)), per_row


def _inside_quotes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True from an opening quote up to, but without, its closing quote."""
    n = len(data)
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[1:], after[:-1] = data[:-1], data[1:]
    before[:1] = after[-1:] = 0x20
    lens = np.diff(offsets)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    last = np.zeros(n + 1, bool)
    last[np.maximum(offsets[1:] - 1, 0)] = True
    in_word = _WORD[before] & _WORD[after] & ~first[:n] & ~last[:n]
    inside, kinds, marks = np.zeros(n, bool), [], []
    for q in _QUOTES:
        mark = (data == q) & ~in_word & (before != 0x5C)
        seen, total = _row_sums(mark, offsets)
        even = (total > 0) & (total % 2 == 0)
        kinds.append(total > 0)
        marks.append(mark)
        inside |= np.repeat(even, lens) & ((seen + mark) % 2 == 1)
    mixed = np.repeat(kinds[0] & kinds[1], lens)
    if mixed.any():
        inside = np.where(mixed, _inside_mixed(marks[0] & mixed, marks[1] & mixed, offsets), inside)
    return inside


def _inside_mixed(first: np.ndarray, second: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Quoted bytes where both characters occur: the one that opens decides, until its like closes.

    Each mark is a map of the three states (outside, in the first, in the second);
    the maps are composed by a doubling scan, and the first mark of a row forgets
    what came before. A quote that never closes in its row is ordinary text.
    """
    at = np.flatnonzero(first | second)
    row = np.searchsorted(offsets, at, side="right") - 1
    maps = np.where(first[at][:, None], np.array([1, 0, 2]), np.array([2, 1, 0]))
    start = np.concatenate(([True], row[1:] != row[:-1]))
    maps[start] = maps[start, :1]
    step = 1
    while step < len(at):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    after = maps[:, 0]
    before = np.where(start, 0, np.concatenate(([0], after[:-1])))
    opens, closes = (before == 0) & (after != 0), (before != 0) & (after == 0)
    last = np.concatenate((start[1:], [True]))
    loose = np.unique(row[last & (after != 0)])
    if len(loose):  # the last opening of these rows has no end
        of = np.flatnonzero(opens)
        final = np.concatenate((row[of][1:] != row[of][:-1], [True]))
        opens[of[final & np.isin(row[of], loose)]] = False
    change = np.zeros(len(first) + 1, np.int64)
    change[at[opens]] += 1
    change[at[closes]] -= 1
    return np.cumsum(change[:-1]) > 0


def split_packed(column: pa.Array, packing: Packing) -> pa.ListArray:
    """Members of each value, in order; null for a missing value."""
    column = column.cast(pa.string())
    known = pc.fill_null(column, "")
    arr = _strip_outer(known.combine_chunks() if isinstance(known, pa.ChunkedArray) else known)
    arr = pc.if_else(pc.is_in(pc.utf8_lower(arr), pa.array(NO_VALUE)), "", arr)
    if packing.numbers:  # a blank after each value keeps the unit pattern from reading into the next row
        arr = pc.binary_join_element_wise(arr, " ", "")
    data, offsets = _bytes(arr)
    n, size, lens = len(arr), len(data), np.diff(offsets)
    inside = _inside_quotes(data, offsets)
    opens, n_open = _row_sums((data == 0x28) & ~inside, offsets)
    closes, n_close = _row_sums((data == 0x29) & ~inside, offsets)
    protected = inside | (np.repeat(n_open == n_close, lens) & (opens + ((data == 0x28) & ~inside) - closes > 0))
    cut = _DELIMITERS[data]
    raw = data.tobytes()
    if packing.numbers:
        comma = np.flatnonzero((data[1:-1] == 0x2C) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]) + 1 if size > 2 else []
        cut[comma] = False
        cut[[m.start(1) for m in _UNIT_SLASH.finditer(raw)]] = False
    for wide in _WIDE:
        at = raw.find(wide)
        while at >= 0:
            cut[at: at + 3] = True
            at = raw.find(wide, at + 3)
    blank = _BLANK[data]
    if blank.any():
        cut |= blank & _between(data, blank, offsets, packing.ids)
    cut &= ~protected

    # children: pieces between cuts, as offsets into the bytes without the cuts
    at = np.flatnonzero(cut)
    ends = np.sort(np.concatenate((offsets[1:], at)))
    cuts_before = np.concatenate(([0], np.cumsum(cut)))
    parents = np.repeat(np.arange(n), 1 + cuts_before[offsets[1:]] - cuts_before[offsets[:-1]])
    kept = np.concatenate(([0], np.cumsum(~cut)))
    items = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate(([0], kept[ends])).astype(np.int32)),
                                        pa.py_buffer(np.ascontiguousarray(data[~cut])))
    items = pc.utf8_trim_whitespace(items)
    quoted = pc.match_substring_regex(items, r"""(?s)^(?:"[^"]*"|'[^']*')$""")
    items = pc.utf8_trim_whitespace(pc.if_else(quoted, pc.utf8_slice_codeunits(items, 1, -1), items))
    full = pc.greater(pc.binary_length(items), 0).to_numpy(zero_copy_only=False)
    items, parents = items.filter(pa.array(full)), parents[full]
    count = np.bincount(parents, minlength=n)

    # a value whose only member stands for "no value" is missing
    lower = pc.utf8_lower(items)
    names = NO_VALUE if "none" in packing.real else (*NO_VALUE, "none")
    void = pc.is_in(lower, pa.array(names))
    if packing.real:
        void = pc.or_(void, pc.and_(pc.equal(lower, "none"), pc.invert(pc.is_in(items, pa.array(packing.real)))))
        void = pc.and_(void, pc.invert(pc.is_in(items, pa.array(packing.real))))
    drop = void.to_numpy(zero_copy_only=False) & (count[parents] == 1)
    items, parents = items.filter(pa.array(~drop)), parents[~drop]
    count = np.bincount(parents, minlength=n)
    list_offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(list_offsets), items, mask=pa.array(count == 0))


def _between(data: np.ndarray, blank: np.ndarray, offsets: np.ndarray, digits: bool) -> np.ndarray:
    """Blanks whose nearest other bytes are two quotes (or, for ids, two digits) of the same row."""
    n = len(data)
    pos = np.arange(n)
    left = np.maximum.accumulate(np.where(blank, -1, pos))
    right = np.minimum.accumulate(np.where(blank, n, pos)[::-1])[::-1]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    l, r = np.maximum(left, 0), np.minimum(right, n - 1)
    ok = (left >= 0) & (right < n) & (row[l] == row) & (row[r] == row)
    a, b = data[l], data[r]
    both = np.isin(a, _QUOTES) & (a == b)
    if digits:
        both |= _DIGIT[a] & _DIGIT[b]
    return ok & both


def flatten_lists(lists: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Parent ordinal, position from 1, number of siblings, and item of each list entry."""
    parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    pos = np.arange(len(parents)) - first[parents] + 1
    return (pa.array(parents), pa.array(pos.astype(np.int32)), pa.array(counts[parents].astype(np.int32)),
            lists.flatten())


def explode_packed(df: DataFrame, fields: dict[str, Packing], keep: list[str], min_members: int = 1) -> DataFrame:
    """``keep`` columns plus ``(field, pos, n, item)``: one row per member of each field with ``min_members`` or more.

    Output names are fixed, so ``keep`` must not hold a column called field, pos, n or item.
    """
    clash = {"field", "pos", "n", "item"} & set(keep)
    if clash:
        raise ValueError(f"rename {sorted(clash)} first")
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("field", T.StringType()),
                           T.StructField("pos", T.IntegerType()), T.StructField("n", T.IntegerType()),
                           T.StructField("item", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packing in fields.items():
                parent, pos, n, item = flatten_lists(split_packed(batch.column(name), packing))
                wide = pc.greater_equal(n, min_members)
                parent, pos, n, item = (x.filter(wide) for x in (parent, pos, n, item))
                out = [batch.column(c).take(parent) for c in keep]
                yield pa.RecordBatch.from_arrays([*out, pa.array([name] * len(item), pa.string()), pos, n, item],
                                                 names=[*keep, "field", "pos", "n", "item"])

    return df.select(*dict.fromkeys([*keep, *fields])).mapInArrow(run, schema)


def split_repeated(column: pa.Array, packing: Packing) -> pa.ListArray:
    """``split_packed``, reading each distinct text of the column once."""
    coded = column.cast(pa.string()).dictionary_encode()
    return split_packed(coded.dictionary, packing).take(coded.indices)


def packed_lists(df: DataFrame, fields: dict[str, Packing], keep: list[str]) -> DataFrame:
    """``keep`` columns plus an array of members per field; null where the value is missing."""
    schema = T.StructType([*(df.schema[c] for c in keep),
                           *(T.StructField(f"{f}_members", T.ArrayType(T.StringType())) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [split_repeated(batch.column(f), p) for f, p in fields.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *lists],
                                             names=[*keep, *(f"{f}_members" for f in fields)])

    return df.select(*dict.fromkeys([*keep, *fields])).mapInArrow(run, schema)
