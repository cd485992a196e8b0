import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trialforge.llm.attribution import attribute, encoder, spans_of_lines
from trialforge.llm.common import WordTokenizer, splits_parts, vocabulary_path
from trialforge.llm.packing import CapacityTree, best_fit_decreasing

PATH = vocabulary_path("word_bpe_49k.json")
TOKENS = WordTokenizer(PATH, splits_parts(PATH), most=40)
LETTERS = st.one_of(st.text(), st.text("aeé ßñİſΣσ'\"<|>,.1٣ \t\n\x1c\xa0AbÀ́日"), st.sampled_from(["<|endoftext|>", "don't stop", "thtion, ÉTÉ!!", "x<|startoftext|>y"]))


@settings(max_examples=400, deadline=None)
@given(LETTERS)
def test_ids_of_words_are_ids_of_the_text(text):
    raw = text.encode("utf-8", "replace")
    want = TOKENS.encode(raw.decode(), add_special_tokens=False).ids
    assert np.frombuffer(TOKENS.ids(raw), "<u4").tolist() == want


def plain_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(bins) if room >= x]
        if fits:
            bins[min(fits)[1]] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.just(20))
def test_runs_are_best_fit_decreasing(lengths, capacity):
    counts = {x: lengths.count(x) for x in set(lengths)}
    filled, at = {}, {}
    for length, a, b, first, per, used in best_fit_decreasing(counts, capacity):
        for r in range(a, b):
            place = (first + (r - a) // per, used + (r - a) % per * length)
            assert (length, r) not in at
            at[length, r] = place
            filled.setdefault(place[0], []).append((place[1], length))
    assert sorted(at) == sorted((x, r) for x, n in counts.items() for r in range(n))
    for items in filled.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(capacity - sum(n for _, n in x) for x in filled.values()) == plain_best_fit(lengths, capacity)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 33))))
def test_tree_finds_the_tightest(steps):
    tree, rooms = CapacityTree(33), []
    for add, x in steps:
        want = min((r for r in rooms if r >= x), default=None)
        assert tree.tightest(x) == want
        if add:
            tree.add(x, 0, 1, 0)
            rooms.append(x)
        elif want is not None:
            tree.take(want)
            rooms.remove(want)


@settings(max_examples=200, deadline=None)
@given(st.text("ab é\n日"), st.sampled_from(["first", "last", "most"]))
def test_tokens_go_to_lines_by_their_spans(text, rule):
    encoding, sizes = encoder(vocabulary_path("byte_bpe_50k.tiktoken"))
    assert isinstance(encoding, tiktoken.Encoding)
    raw, ids = text.encode(), encoding.encode_ordinary(text)
    sections = spans_of_lines(raw)
    ends = np.cumsum(sizes[ids]) if ids else np.zeros(0, int)
    owner_of_byte = [sum(1 for s in sections if s <= b) - 1 for b in range(len(raw))]
    want, crossing = [0] * len(sections), [0] * len(sections)
    for a, b in zip(ends - sizes[ids] if ids else [], ends, strict=True):
        mine = owner_of_byte[a:b]
        o = {"first": mine[0], "last": mine[-1], "most": max(sorted(set(mine)), key=mine.count)}[rule]
        want[o] += 1
        crossing[o] += mine[0] != mine[-1]
    if ids:
        got = attribute(ends - sizes[ids], sections, len(raw), rule)
        assert (got[0].tolist(), got[1].tolist()) == (want, crossing)
