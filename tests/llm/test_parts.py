"""Parts of the operators that need no Spark."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from reviewloom.llm import chat, quality, repeats, secrets
from reviewloom.llm.ngram_join import PartEnum, links_within
from reviewloom.llm.textnum import Words, mix, shingles


@given(st.lists(st.sampled_from(["<", "[", "s>", "/s>", "\\", "INST]", "|role|>", "x"]), max_size=12))
def test_escaping_can_be_undone(parts):
    text = "".join(parts)
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a</s>"]),
                          st.text("<s>/[INST]|role \\", max_size=12)), max_size=4))
def test_turns_are_read_back(turns):
    write = chat.compile_template(chat.TEMPLATE)
    pieces = write((chat.escape(r), chat.escape(t)) for r, t in turns)
    assert [(r, t) for r, t, _ in chat.read_turns(pieces)] == turns


def test_constants_are_folded():
    tree = chat.fold(chat.parse('{% if "a" == "a" and not "b" == "c" %}x{{ "y" + "z" }}{% else %}n{% endif %}'))
    assert [(n.kind, n.value) for n in tree.parts] == [("const", "xyz")]


@pytest.mark.parametrize("template", [
    "{% for x in y %}{% endfor %}", "{{ message.__class__ }}", "{% if loop.first %}", "{{ open }}",
    "{% endif %}", '{{ "a" + }}', "{% include 'x' %}", "{{ (message.text }}",
    "{% if loop.first %}{% else %}{% else %}{% endif %}"])
def test_other_languages_are_refused(template):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(template)


def test_trigram_queries():
    asked = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert asked["access"] == {frozenset({"aki", "kia"})}
    assert frozenset() in asked["hex"] and frozenset() not in asked["assign"]
    assert frozenset({"tok", "oke", "ken"}) in asked["assign"]
    assert frozenset({"api", "pik", "ike", "key"}) in asked["assign"]
    assert all(frozenset() not in q for k, q in asked.items() if k != "hex")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=8), st.integers(2, 8))
def test_run_length_index_marks_what_repeats(strings, length):
    strings = [s.encode() for s in strings]
    index = repeats.RunLengthIndex(strings)
    start, stop = index.long_matches(length)
    got = {p for a, b in zip(start.tolist(), stop.tolist()) for p in range(a, b)}
    seen: dict[bytes, list] = {}
    for at, s in zip(index.begin.tolist(), strings):
        for p in range(len(s) - length + 1):
            seen.setdefault(s[p:p + length], []).append(at + p)
    want = {q for places in seen.values() if len(places) > 1 for p in places for q in range(p, p + length)}
    assert got == want
    assert int(index.lengths.sum()) == sum(map(len, strings)) + len(strings)


@given(st.lists(st.integers(0, 20), max_size=50), st.integers(1, 9))
def test_sliding_minimum(keys, width):
    want = [min(keys[i:i + width]) for i in range(len(keys) - width + 1)]
    assert repeats.sliding(np.array(keys, np.uint64), width).tolist() == want
    want = [max(keys[i:i + width]) for i in range(len(keys) - width + 1)]
    assert repeats.sliding(np.array(keys, np.uint64), width, np.maximum).tolist() == want


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    pick, enum = random.Random(7), PartEnum(percent)
    for _ in range(300):
        n = pick.choice([3, 9, 12, 19, 20, 28, 43, 65, 150, 700])
        a = {pick.getrandbits(64) for _ in range(n)}
        b = set(a)
        while True:  # as far apart as the similarity allows
            c = set(b)
            if pick.random() < 0.5 and c:
                c.remove(pick.choice(sorted(c)))
            else:
                c.add(pick.getrandbits(64))
            if 100 * len(a & c) < percent * len(a | c):
                break
            b = c
        if a == b:
            continue
        values = [np.sort(np.array(list(s), np.uint64)) for s in (a, b)]
        rows = np.repeat([0, 1], [len(a), len(b)])
        row, sign = enum.sign(rows, np.concatenate(values), np.array([len(a), len(b)]))
        assert set(sign[row == 0].tolist()) & set(sign[row == 1].tolist())


def test_links_within_connects_exactly():
    pick = random.Random(3)
    base = [pick.getrandbits(64) for _ in range(60)]
    sets = []
    for _ in range(30):
        sets.append(sorted({*pick.sample(base, 55), pick.getrandbits(64)}))
    arrays = [np.array(s, np.uint64) for s in sets]
    near = {(i, j) for i in range(30) for j in range(i)
            if 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})}

    def groups(links):
        up = list(range(30))
        for _ in range(30):
            for i, j in links:
                up[i] = up[j] = min(up[i], up[j])
        return up

    found = links_within(arrays, 80)
    assert groups(found) == groups(near) and len(found) < 30


def test_shingles_are_distinct_and_short_rows_are_one():
    texts = [b"A b  c d a B c d", b"a b c d", b"", b"x", b"x y", "é É é É é".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows, values = shingles(Words(data, np.array([len(t) for t in texts])), 3)
    assert np.bincount(rows, minlength=6).tolist() == [4, 2, 0, 1, 1, 2]
    assert set(values[rows == 1].tolist()) <= set(values[rows == 0].tolist())
    assert len(set(mix(values).tolist())) == 8


def test_additive_model_learns_an_interaction():
    pick = np.random.default_rng(1)
    x = pick.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=30)
    assert (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
