import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from netloom.llm.words import grams, text_buffer, unique_per_document, words_of

TEXT = st.text(alphabet="ab \t\n\x0b\x0c\r\x85 é𝄞,", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 30))
def test_words_are_runs_of_other_bytes(texts, chunk):
    column = pa.array(texts, pa.string())
    data, _ = text_buffer(column)
    seen, rows = {}, []
    for w in words_of(column, chunk):
        for d in range(w.documents):
            a, b = w.first[d], w.first[d + 1]
            own = [bytes(data[s:e]) for s, e in zip(w.starts[a:b], w.ends[a:b])]
            rows.append(own)
            for word, h in zip(own, w.hashes[a:b]):
                assert seen.setdefault(word, int(h)) == int(h)
    assert rows == [(t or "").encode().split() for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_grams_do_not_cross_documents():
    texts = ["a b c d e f", "", "a b", None, "b c d e f g h", "a b"]
    w = next(words_of(pa.array(texts)))
    g, first = grams(w, 5)
    assert np.diff(first).tolist() == [2, 0, 1, 0, 3, 1]
    assert g[1] == g[3] and g[2] == g[6] and len(set(g.tolist())) == 5
    assert np.diff(grams(w, 5, short=False)[1]).tolist() == [2, 0, 0, 0, 3, 0]
    v, f = unique_per_document(np.array([3, 1, 3, 2, 2], np.uint64), np.array([0, 3, 3, 5]))
    assert v.tolist() == [1, 3, 2] and f.tolist() == [0, 2, 2, 3]
