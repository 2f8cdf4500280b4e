"""Places of many documents at once, by select."""

import numpy as np
import pytest

from freightspark.llm.token_store import EliasFano, Segment


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 0), (500, 3), (1000, 10**12)])
def test_many_integers_at_once(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    e = EliasFano.from_bytes(EliasFano.encode(v).to_bytes())
    assert e.at(np.arange(n)).tolist() == v.tolist() == [e[i] for i in range(n)]


def test_places_are_those_of_single_documents():
    own, ends = [3, 3, 10**9], np.array([1, 4, 5, 9])
    row = {"n_null": 1, "first": 3, "width": 2, "ids": bytes(18), "doc_ids": EliasFano.encode(np.array(own) - 3).to_bytes(), "bounds": EliasFano.encode(ends).to_bytes()}
    s = Segment(row)
    known, got = s.places()
    assert [None, *known.tolist()] == [s.doc_id(i) for i in range(4)] and got.tolist() == [a + len(x) for a, x in map(s.document, range(4))]
