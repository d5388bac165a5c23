"""A column of JSON texts as one table of nodes, read off the Arrow data buffer by whole-buffer kernels.

No text is parsed by itself. Quotes, escapes and brackets of all texts are found at once in their joint bytes; running sums
tell what lies in a string and how deep; one stable sort by depth gives every value its parent. The grammar is checked on
the same arrays, by what may follow what. Values stay where they are, as offsets into the buffer, until a column of them is
asked for. Depth costs nothing but the sort, so nesting has no limit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJECT, ARRAY, STRING, SCALAR = range(4)
NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"
_SCALAR = rf"^(?:true|false|null|{NUMBER})$"

_MARK = np.zeros(256, bool)
_MARK[list(b'"{}[]:,')] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r")] = True
_PLAIN = np.zeros(256, np.uint8)  # what an escaped byte stands for, 0 for none
for _a, _b in zip(b'"\\/bfnrt', b'"\\/\b\f\n\r\t'):
    _PLAIN[_a] = _b
_HEX = np.full(256, -1, np.int32)
for _c in "0123456789abcdefABCDEF":
    _HEX[ord(_c)] = int(_c, 16)

# What a token may follow. Rows: the state after the token before; columns: the kind of token.
_START, _IN_OBJECT, _IN_ARRAY, _COLON, _COMMA_OBJECT, _COMMA_ARRAY, _KEY, _DONE_OBJECT, _DONE_ARRAY, _DONE = range(10)
_T_VALUE, _T_STRING, _T_END_OBJECT, _T_END_ARRAY, _T_COLON, _T_COMMA = range(6)
_MAY = np.zeros((10, 6), bool)
for _state, _tokens in {
    _START: (_T_VALUE, _T_STRING), _IN_OBJECT: (_T_STRING, _T_END_OBJECT), _IN_ARRAY: (_T_VALUE, _T_STRING, _T_END_ARRAY), _COLON: (_T_VALUE, _T_STRING),
    _COMMA_OBJECT: (_T_STRING,), _COMMA_ARRAY: (_T_VALUE, _T_STRING), _KEY: (_T_COLON,), _DONE_OBJECT: (_T_COMMA, _T_END_OBJECT), _DONE_ARRAY: (_T_COMMA, _T_END_ARRAY),
}.items():
    _MAY[_state, list(_tokens)] = True


@dataclass
class Nodes:
    """One row for each value of the valid texts, in order; parent -1 for a text's root, key -1 where there is none."""

    row: np.ndarray  # which text
    parent: np.ndarray
    kind: np.ndarray
    key: np.ndarray  # place in names
    begin: np.ndarray
    end: np.ndarray
    names: pa.StringArray  # distinct keys
    data: pa.Buffer

    def slices(self, nodes: np.ndarray) -> pa.LargeStringArray:
        """The bytes of nodes (in increasing order) as they stand, by offsets into the buffer."""
        return _slices(self.data, self.begin[nodes], self.end[nodes])


def _slices(data: pa.Buffer, begin: np.ndarray, end: np.ndarray) -> pa.LargeStringArray:
    """Every second value of an array whose offsets are begin, end, begin, end ..."""
    n = len(begin)
    if not n:
        return pa.array([], pa.large_string())
    offsets = np.empty(2 * n, np.int64)
    offsets[0::2], offsets[1::2] = begin, end
    between = pa.LargeStringArray.from_buffers(2 * n - 1, pa.py_buffer(offsets), data)
    return between.take(pa.array(np.arange(0, 2 * n, 2)))


def _escapers(data: np.ndarray) -> np.ndarray:
    """Places of the backslashes that escape the byte after them: of a run of them every second one."""
    at = np.flatnonzero(data == 92)
    if not len(at):
        return at
    starts = np.r_[True, np.diff(at) != 1]
    run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - run) % 2 == 0]


def unescaped(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """JSON string contents without their escapes; half a surrogate pair is U+FFFD."""
    escaped = pc.fill_null(pc.match_substring(texts, "\\"), False)
    if not pc.any(escaped).as_py():
        return texts
    plain = _unescape(texts.filter(escaped))
    where = np.flatnonzero(escaped.to_numpy(zero_copy_only=False))
    order = np.arange(len(texts))
    order[where] = len(texts) + np.arange(len(where))
    return pa.concat_arrays([texts, plain]).take(pa.array(order))


def _unescape(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy()
    offsets = offsets - offsets[0]
    at = _escapers(data)
    keep = np.ones(len(data), bool)
    code = data[at + 1]
    coded = at[code == 117]
    simple = at[code != 117]
    data[simple + 1] = _PLAIN[data[simple + 1]]
    keep[simple] = False
    if len(coded):
        digits = _HEX[data[coded[:, None] + np.arange(2, 6)]]
        point = (digits * np.array([4096, 256, 16, 1])).sum(1)
        high, low = (point >= 0xD800) & (point < 0xDC00), (point >= 0xDC00) & (point < 0xE000)
        pair = np.zeros(len(coded), bool)
        pair[:-1] = high[:-1] & low[1:] & (np.diff(coded) == 6)
        second = np.r_[False, pair[:-1]]
        joint = 0x10000 + ((point & 0x3FF) << 10)
        joint[:-1] += point[1:] & 0x3FF
        point = np.where(pair, joint, np.where(high | low, 0xFFFD, point))
        size = np.where(point < 0x80, 1, np.where(point < 0x800, 2, np.where(point < 0x10000, 3, 4)))
        size[second] = 0
        keep[(coded[:, None] + np.arange(6)).ravel()] = False
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for n in (1, 2, 3, 4):
            own = size == n
            for k in range(n):
                bits = point[own] >> (6 * (n - 1 - k))
                data[coded[own] + k] = (lead[n] | bits) if k == 0 else (0x80 | bits & 0x3F)
                keep[coded[own] + k] = True
    kept = np.r_[0, np.cumsum(keep)]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(kept[offsets].astype(np.int64)), pa.py_buffer(data[keep].tobytes()))


def parse(texts: pa.Array) -> Nodes:
    """The nodes of all texts that are valid JSON; null and other texts have none."""
    joint = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))  # a blank ends each text
    offsets = np.frombuffer(joint.buffers()[1], np.int64)[joint.offset : joint.offset + len(joint) + 1]
    whole = joint.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[: offsets[-1]] if whole is not None and len(joint) else np.empty(0, np.uint8)
    n_rows = len(joint)
    bad = np.zeros(n_rows, bool)
    row_of = lambda at: np.searchsorted(offsets, at, "right") - 1

    # Strings: quotes that nothing escapes, by turns opening and closing within each text.
    escapers = _escapers(data)
    escapes = np.zeros(len(data) + 1, bool)
    escapes[escapers + 1] = True
    marks = np.flatnonzero(_MARK[data])
    quote = (data[marks] == 34) & ~escapes[marks]
    quotes = marks[quote]
    at_start = np.searchsorted(quotes, offsets)
    bad |= (np.diff(at_start) % 2).astype(bool)
    mark_row = row_of(marks)
    inside = (np.cumsum(quote) - quote - at_start[mark_row]) % 2 == 1  # before the mark itself
    opening = quote & ~inside
    outside = ~quote & ~inside
    bad[_rows_within(np.flatnonzero(data < 32), quotes, at_start, row_of)] = True
    follow = data[np.minimum(escapers + 1, max(len(data) - 1, 0))] if len(escapers) else np.empty(0, np.uint8)
    wrong = (_PLAIN[follow] == 0) & (follow != 117)
    coded = escapers[follow == 117]
    if len(coded):
        short = coded + 5 >= len(data)
        digits = _HEX[data[np.minimum(coded[:, None] + np.arange(2, 6), len(data) - 1)]]
        bad[row_of(coded[short | (digits < 0).any(1)])] = True
    bad[row_of(escapers[wrong])] = True

    # Tokens: marks outside strings, strings, and what else stands between them.
    closing = np.flatnonzero(quote & inside)
    opens_at = np.flatnonzero(opening)
    string_end = np.zeros(len(marks), np.int64)
    string_end[opens_at] = offsets[mark_row[opens_at] + 1]  # a string that nothing closes takes the rest of its text
    following = np.searchsorted(closing, opens_at)
    ended = following < len(closing)
    ended[ended] = mark_row[closing[following[ended]]] == mark_row[opens_at[ended]]
    string_end[opens_at[ended]] = marks[closing[following[ended]]] + 1
    picked = np.flatnonzero(opening | outside)
    start = marks[picked]
    is_string = opening[picked]
    stop = np.where(is_string, string_end[picked], start + 1)
    row = mark_row[picked]
    edges = np.searchsorted(row, np.arange(n_rows + 1))
    gap_from = np.concatenate([stop, offsets[:-1]])
    next_start = np.r_[start[1:], 0][: len(start)]
    last_of_row = np.r_[row[1:] != row[:-1], True] if len(row) else np.empty(0, bool)
    next_start[last_of_row] = offsets[row[last_of_row] + 1]
    first_start = offsets[1:].copy()
    filled = edges[:-1] < edges[1:]
    first_start[filled] = start[edges[:-1][filled]]
    gap_to = np.concatenate([next_start, first_start])
    solid = ~_BLANK[data]
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=count[1:])
    gap_to = np.maximum(gap_to, gap_from)  # only texts already known as bad have such gaps
    full = np.flatnonzero(count[gap_to] > count[gap_from])
    places = np.flatnonzero(solid)
    lone_from, lone_to = places[count[gap_from[full]]], places[count[gap_to[full]] - 1] + 1
    token_start, token_stop = np.concatenate([start, lone_from]), np.concatenate([stop, lone_to])
    byte = np.concatenate([data[start], np.zeros(len(full), np.uint8)])
    order = np.argsort(token_start, kind="stable")
    token_start, token_stop, byte = token_start[order], token_stop[order], byte[order]
    row = row_of(token_start)
    n = len(byte)
    first = np.r_[True, row[1:] != row[:-1]] if n else np.empty(0, bool)
    last = np.r_[first[1:], True] if n else np.empty(0, bool)

    # Depth and parents.
    opener, closer = (byte == 123) | (byte == 91), (byte == 125) | (byte == 93)
    running = np.cumsum(opener.astype(np.int64) - closer)
    before = running - opener + closer
    base = before[first][np.cumsum(first) - 1] if n else before
    level = before - base
    bad[row[(level < 0) | (last & (running - base != 0)) | (closer & (level <= 0))]] = True
    parent = _parents(level, opener)
    context = np.where(parent >= 0, byte[parent], 0)

    # The grammar: what follows what, in which container.
    string, lone = byte == 34, byte == 0
    previous = np.r_[0, byte[:-1]] if n else byte
    previous[first] = 0
    is_key = string & (context == 123) & ((previous == 123) | (previous == 44))
    kind = np.select([string, byte == 125, byte == 93, byte == 58, byte == 44], [_T_STRING, _T_END_OBJECT, _T_END_ARRAY, _T_COLON, _T_COMMA], _T_VALUE)
    done = np.where(context == 123, _DONE_OBJECT, np.where(context == 91, _DONE_ARRAY, _DONE))
    outer = np.where(parent >= 0, context[parent], 0)  # around the container that a closing mark ends
    closed = np.where(outer == 123, _DONE_OBJECT, np.where(outer == 91, _DONE_ARRAY, _DONE))
    comma = np.where(context == 123, _COMMA_OBJECT, _COMMA_ARRAY)
    after = np.select([byte == 123, byte == 91, byte == 58, byte == 44, is_key, closer], [_IN_OBJECT, _IN_ARRAY, _COLON, comma, _KEY, closed], done)
    state = np.r_[_START, after[:-1]] if n else after
    state[first] = _START
    bad[row[~_MAY[state, kind] | (closer & (context != np.where(byte == 125, 123, 91))) | (last & (after != _DONE))]] = True
    lone_at = np.flatnonzero(lone)
    if len(lone_at):
        valid = pc.match_substring_regex(_slices(whole, token_start[lone_at], token_stop[lone_at]), _SCALAR).to_numpy(zero_copy_only=False)
        bad[row[lone_at[~valid]]] = True

    # Nodes: the values of the texts that are left.
    value = ((string & ~is_key) | lone | opener) & ~bad[row]
    nodes = np.flatnonzero(value)
    number = np.full(n + 1, -1)
    number[nodes] = np.arange(len(nodes))
    keyed = nodes[context[nodes] == 123]
    key_token = keyed - 2  # key, colon, value
    key = np.full(len(nodes), -1)
    names = _slices(whole, token_start[key_token] + 1, token_stop[key_token] - 1).dictionary_encode()
    key[number[keyed]] = names.indices.to_numpy()
    own = byte[nodes]
    kinds = np.select([own == 123, own == 91, own == 34], [OBJECT, ARRAY, STRING], SCALAR)
    quoted = own == 34
    return Nodes(row[nodes], np.where(parent[nodes] >= 0, number[parent[nodes]], -1), kinds, key, token_start[nodes] + quoted, token_stop[nodes] - quoted, unescaped(names.dictionary), whole)


def _rows_within(at: np.ndarray, quotes: np.ndarray, at_start: np.ndarray, row_of) -> np.ndarray:
    """The texts of those places that lie in a string."""
    row = row_of(at)
    return row[(np.searchsorted(quotes, at) - at_start[row]) % 2 == 1]


def _parents(level: np.ndarray, opener: np.ndarray) -> np.ndarray:
    """For each token the last bracket before it that opens its level, -1 for none: a stable sort by level puts both side by side."""
    n = len(level)
    index = np.repeat(np.arange(n), 1 + opener)
    inner = np.r_[False, index[1:] == index[:-1]] if len(index) else np.empty(0, bool)
    key = np.maximum(level[index], 0) + inner
    order = np.argsort(key.astype(np.int16) if not n or key.max() < 1 << 15 else key, kind="stable")
    holds = inner[order]
    latest = np.maximum.accumulate(np.where(holds, np.arange(len(order)), -1)) if n else np.empty(0, np.int64)
    parent = np.full(n, -1)
    plain = ~holds
    at = latest[plain]
    parent[index[order][plain]] = np.where(at >= 0, index[order][at], -1)
    parent[level <= 0] = -1
    return parent
