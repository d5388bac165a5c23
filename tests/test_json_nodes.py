"""The node table against a plain JSON parser, on random texts, broken ones among them."""

import json
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from annoloom.operators import json_nodes as jn

LEAVES = [1, -2, 0, 1.5, 1e10, True, False, None, "", 'a"b\\', "x\n\té€😀\u0001", "{[,:]}", "日本", "\\\\", "\\"]


def rebuilt(texts):
    nodes = jn.parse(pa.array(texts, pa.string()))
    under = [[] for _ in nodes.row]
    roots = {}
    for i, p in enumerate(nodes.parent):
        if p < 0:
            roots[int(nodes.row[i])] = i
        else:
            under[p].append(i)
    raw = nodes.slices(np.arange(len(nodes.row)))
    plain, raw, names = jn.unescaped(raw).to_pylist(), raw.to_pylist(), nodes.names.to_pylist()

    def value(i):
        kind = nodes.kind[i]
        if kind == jn.OBJECT:
            return {names[nodes.key[j]]: value(j) for j in under[i]}
        return [value(j) for j in under[i]] if kind == jn.ARRAY else plain[i] if kind == jn.STRING else json.loads(raw[i])

    return {row: json.dumps(value(i)) for row, i in roots.items()}


def no_constant(x):
    raise ValueError(x)


def expected(text):
    try:
        x = json.dumps(json.loads(text, parse_constant=no_constant), ensure_ascii=False)
    except ValueError:
        return None
    whole = x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # half a surrogate pair is U+FFFD
    return json.dumps(json.loads(whole))


def random_value(rng, depth=0):
    r = rng.random()
    if depth > 4 or r < 0.3:
        return rng.choice(LEAVES)
    if r < 0.65:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b_C", 'q"k', "é", "\\", ""]): random_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def random_text(rng):
    text = json.dumps(random_value(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]))
    for _ in range(rng.choice([0, 0, 1, 2])):
        at = rng.randrange(len(text) + 1)
        text = text[:at] + rng.choice([*'{}[]:,"\\ \n1tn-.', "\\u12", "null", "\x01", ""]) + text[at + rng.randrange(2) :]
    return text


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30))
def test_random_texts(seed):
    rng = random.Random(seed)
    texts = [random_text(rng) for _ in range(30)]
    got = rebuilt(texts)
    for i, text in enumerate(texts):
        assert (got.get(i), rebuilt([text]).get(0)) == (expected(text),) * 2, text


def test_odd_texts():
    texts = ["", None, " ", "{", "3", '"x"', "[]", "null", "nul", "01", "1.", "-", "[1,]", "{,}", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", r'"\u12g4"', r'"😀"', "[}", "{]", "]", "[]]", "[[]", '"a" "b"', "NaN", "[NaN]", "1e5", '{"a":1 "b":2}', '{"a" 1}', "[:]", '"\\', '\\"', r'"\\"', '"\\u12']
    got = rebuilt(texts)
    for i, text in enumerate(texts):
        assert got.get(i) == expected(text or ""), text


def test_depth_has_no_limit():
    deep = "[" * 200_000 + "1" + "]" * 200_000
    nodes = jn.parse(pa.array([deep, deep + "]"]))
    assert len(nodes.row) == 200_001 and set(nodes.row) == {0} and nodes.parent.tolist() == list(range(-1, 200_000))
