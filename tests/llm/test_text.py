import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.text import Words, shingle_keys, unique_counts

texts = st.lists(st.one_of(st.none(), st.text(alphabet="abé \n\t\x0bß,", max_size=40)), max_size=8)
SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    out = [""]
    for c in (text or "").lower():
        if c in SPACES:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_and_their_hashes(rows):
    found = Words(pa.array(rows, pa.string()))
    expected = [(i, w) for i, t in enumerate(rows) for w in words_of(t)]
    data = found.data.tobytes()
    assert [(int(d), data[a:b].decode()) for d, a, b in zip(found.doc, found.starts, found.ends, strict=True)] == expected
    by_word = {}
    for (_, w), h in zip(expected, found.hashes().tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_shingles(rows):
    keys, times = unique_counts(shingle_keys(Words(pa.array(rows, pa.string())), 3))
    expected = {}
    for i, t in enumerate(rows):
        w = words_of(t)
        for s in [tuple(w[j : j + 3]) for j in range(len(w) - 2)] or ([tuple(w)] if w else []):
            expected[i, s] = expected.get((i, s), 0) + 1
    assert sorted((int(k) >> 48, int(n)) for k, n in zip(keys, times, strict=True)) == sorted((i, n) for (i, _), n in expected.items())


def test_slices_of_arrays_keep_their_offsets():
    whole = pa.array(["x y", "a b c", None, "d"])
    part = Words(whole.slice(1, 3))
    assert part.counts.tolist() == [3, 0, 1]
    assert part.hashes().tolist() == Words(pa.array(["a b c", None, "d"])).hashes().tolist()
