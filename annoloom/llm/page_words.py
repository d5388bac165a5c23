"""The words of many pages at once, read off the Arrow buffer: where they stand, what is a link, what stands in a list.

No word of any language is looked up. Marks decide: words between links, commas, bullets, bars, brackets and line ends are
items, and a stretch of text that no full stop ends and whose items are short is a list, as is one that says few words again
and again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# How links and tags are written (RE2), words joined to a tag, marks between the items of a list, marks that end a sentence.
LINKS = "|".join(
    (
        r"<a\s[^<>]*>[^<>]*</a\s*>",
        r"<[/!a-z][^<>]*>",
        r"!?\[[^\[\]\n]*\]\([^()\s]*\)",
        r"\b(?:https?|hxxps?|ftp)\s?:\s?//\S+",
        r"\bwww\.\S+",
        r"[\w-]+\s?\[\.\]\s?[\w-]+(?:/\S*)?",
        r"[\w-]+\s\(?dot\)?\s[\w-]+",
        r"(?:[\w-]+\.)+[a-z]{3,}(?:/\S*)?",
        r"(?:^|\s)/(?:[\w.%-]+/)+[\w.%?=&-]*",
        r"[#$][a-z\x{80}-\x{10FFFF}][\w\x{80}-\x{10FFFF}-]*",
    )
)
JOINED = r"\b[A-Z][a-z]+(?:[-_]?[A-Z][a-z]+)+\b"
BULLETS = r"[·•»«|｜、，・▪►●→–—]|[ \t][-~+][ \t]"
FULL_STOPS = "[。！？]"

_WORD, _BLANK, _ITEM, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("_"), ord("@"), *range(0x80, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_BLANK[list(b" \t\r\n\x01\x02\"')]")] = True
_ITEM[list(b",;|\t()/:>*=\x01")] = True
_STOP[list(b".!?")] = True
_R = np.uint64(0x9E3779B97F4A7C15 | 1)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_kept: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64, kept for the next batch."""
    if len(_kept.get(base, ())) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        _kept[base] = np.multiply.accumulate(out)
    return _kept[base][:n]


@dataclass
class Words:
    page: np.ndarray  # place of the word's page in the batch
    place: np.ndarray  # of the word in its page
    code: np.ndarray  # uint64, equal for equal words, one code for all numbers
    segment: np.ndarray
    link: np.ndarray  # in a link or tag
    listed: np.ndarray  # in a list


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: pa.Array, longest_item: float = 4.0, least_repeated: int = 8) -> Words:
    """All words of all texts; null and blank texts have none."""
    plain = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), JOINED, "#\\0")
    low = pc.utf8_lower(plain)
    low = pc.replace_substring_regex(low, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{A0}\x{2000}-\x{200B}\x{3000}\x{FEFF}]", " ")
    low = pc.replace_substring_regex(low, FULL_STOPS, ".\n")
    low = pc.replace_substring_regex(low, BULLETS, " | ")
    low = pc.replace_substring_regex(low, LINKS, " \x01\\0\x02 ")
    low = pc.binary_join_element_wise(low, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], np.uint8)[: offsets[-1]] if len(low) else np.empty(0, np.uint8)
    n = len(data)
    if not n:
        return Words(*(np.empty(0, np.int64),) * 2, np.empty(0, np.uint64), np.empty(0, np.int64), *(np.empty(0, bool),) * 2)

    # Words: runs of letters and digits; where blanks are not written, runs of one script.
    word = _WORD[data]
    start = word & ~np.r_[False, word[:-1]]
    wide = np.flatnonzero((data >= 0xE3) & (data <= 0xED))
    second, third = data[np.minimum(wide + 1, n - 1)], data[np.minimum(wide + 2, n - 1)]
    kana = (data[wide] == 0xE3) & (second >= 0x81) & (second <= 0x83)
    script = np.where(kana, np.where((second == 0x83) | (second == 0x82) & (third >= 0xA0), 2, 1), 3)
    goes_on = np.r_[False, (np.diff(wide) == 3) & (np.diff(script) == 0)] if len(wide) else np.empty(0, bool)
    start[wide] = ~goes_on
    past = wide[np.r_[np.diff(wide) != 3, True]] + 3 if len(wide) else wide
    past = past[past < n]
    start[past] |= word[past]
    starts = np.flatnonzero(start)
    stop = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    run = np.searchsorted(stop, starts, "right")
    ends = np.minimum(np.r_[starts[1:], n], stop[run])
    # Their codes: differences of one running polynomial, brought to the same power.
    powers = _powers(n, int(_R))
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * powers, out=running[1:])
    back = _powers(n, _inverse(int(_R)))
    code = _mixed((running[ends] - running[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    figures = np.zeros(n + 1, np.int32)
    np.cumsum(_DIGIT[data], out=figures[1:])
    code[figures[ends] - figures[starts] == ends - starts] = 0

    # Segments end with a full stop before a blank, or with a line.
    dot = _STOP[data]
    dot[:-1] &= _BLANK[data[1:]]
    line = data == 10
    cut = dot | line
    bounds = np.flatnonzero(cut)
    segment = np.searchsorted(bounds, starts)
    finished = dot[bounds]
    comma = np.zeros(n, bool)  # inside a number
    comma[1:-1] = (data[1:-1] == 44) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    marks = np.zeros(n + 1, np.int32)
    np.cumsum(_ITEM[data] & ~comma, out=marks[1:])
    opened = np.zeros(n + 1, np.int32)
    np.cumsum((data == 1).astype(np.int8) - (data == 2).astype(np.int8), out=opened[1:])
    link = opened[starts] > 0
    # Lists: segments that no full stop ends, with few words to an item; links are items, not words.
    plain = np.flatnonzero(~link)
    own, mark = segment[plain], marks[starts[plain]]
    fresh = np.r_[True, (own[1:] != own[:-1]) | (mark[1:] != mark[:-1])] if len(plain) else np.empty(0, bool)
    n_words = np.bincount(own, minlength=len(bounds))
    n_items = np.bincount(own, fresh, minlength=len(bounds)) + np.bincount(np.searchsorted(bounds, np.flatnonzero(data == 1)), minlength=len(bounds))
    # Or segments that say few words again and again.
    low_bits = np.uint64(64 - len(bounds).bit_length())  # segment and the rest of the word's code in one number
    packed = np.sort(own.astype(np.uint64) << low_bits | code[plain] >> (np.uint64(64) - low_bits))
    new = np.r_[True, packed[1:] != packed[:-1]] if len(plain) else np.empty(0, bool)
    n_distinct = np.bincount((packed[new] >> low_bits).astype(np.int64), minlength=len(bounds))
    is_list = ~finished & (n_words <= longest_item * n_items) | (n_words >= least_repeated) & (4 * n_distinct <= n_words)
    page = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(page, np.arange(len(low)))
    return Words(page, np.arange(len(starts)) - first[page], code, segment, link, is_list[segment] & ~link)


def shingles(words: Words, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places in words of the first word) of all runs of `width` words of one segment without links."""
    n = len(words.page) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fine = ~words.link[:n]
    code = words.code[:n].copy()
    for k in range(1, width):
        fine &= ~words.link[k : n + k] & (words.segment[k : n + k] == words.segment[:n])
        code = _mixed(code * _R + words.code[k : n + k])
    at = np.flatnonzero(fine)
    return code[at].astype(np.int64), at


def enumerated(words: Words, code: np.ndarray, at: np.ndarray, width: int, least: int = 3, share: float = 0.05) -> np.ndarray:
    """Of each shingle whether its page says it again and again as lists do: at least `least` times, after as many different words and before as
    many, and in at least `share` of the page's words. A sentence said again brings its surroundings along."""
    m = len(words.page)
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    page = words.page[at]
    key = _mixed(code.view(np.uint64) ^ _mixed(page.astype(np.uint64) + np.uint64(1)))
    slot = (key & np.uint64((1 << len(at).bit_length() + 1) - 1)).astype(np.int64)
    rest = np.flatnonzero(np.bincount(slot)[slot] >= least)  # the others are surely said too seldom
    if not len(rest):
        return out
    order = rest[np.argsort(key[rest])]
    fresh = np.r_[True, np.diff(key[order]) != 0]
    run = np.cumsum(fresh) - 1
    count = np.bincount(run)
    often = (count >= least) & (count * width >= share * np.bincount(words.page)[page[order[fresh]]])
    some = np.flatnonzero(often[run])
    own, place = run[some], at[order[some]]
    for other in (place - 1, place + width):
        near = np.clip(other, 0, m - 1)
        same = (other >= 0) & (other < m) & (words.segment[near] == words.segment[place])
        beside = np.where(same, words.code[near], np.uint64(1))
        by = np.lexsort((beside, own))
        first = np.r_[True, (np.diff(own[by]) != 0) | (np.diff(beside[by]) != 0)] if len(by) else np.empty(0, bool)
        often &= np.bincount(own[by], first, minlength=len(count)) >= least
    out[order] = often[run]
    return out
