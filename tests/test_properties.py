"""Properties on generated inputs."""

import json

from hypothesis import given, settings, strategies as st

from ledgerflow.functions import canonical
from ledgerflow.plans import graph

VALUES = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)
EDGES = st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), max_size=14)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_canonical_text_is_json_and_stable(value):
    text = canonical.canonical_text(json.dumps(value))
    assert json.loads(text, parse_int=float) == json.loads(json.dumps(value), parse_int=float)
    assert canonical.canonical_text(text) == text


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.integers(-5, 5), min_size=2, max_size=6))
def test_key_order_does_not_matter(value):
    turned = dict(reversed(value.items()))
    assert canonical.canonical_text(json.dumps(value)) == canonical.canonical_text(json.dumps(turned))
    assert canonical.equivalent_texts(json.dumps(value), json.dumps(turned))


def reachable(edges, start):
    seen, open_ = {start}, [start]
    while open_:
        n = open_.pop()
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                open_.append(b)
    return seen


@settings(max_examples=200, deadline=None)
@given(EDGES)
def test_components_are_mutual_reachability(edges):
    groups = graph.strong_components("abcdefg", edges)
    reach = {n: reachable(edges, n) for n in "abcdefg"}
    assert sorted(n for g in groups for n in g) == list("abcdefg")
    for g in groups:
        assert set(g) == {m for m in "abcdefg" if m in reach[g[0]] and g[0] in reach[m]}


@settings(max_examples=200, deadline=None)
@given(EDGES)
def test_parents_stand_first(edges):
    order = graph.parents_first("abcdefg", edges)
    group = {n: k for k, g in enumerate(graph.strong_components("abcdefg", edges)) for n in g}
    assert sorted(order) == list("abcdefg")
    assert all(order.index(p) < order.index(c) for c, p in edges if group[c] != group[p])
