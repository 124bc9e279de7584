import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import kernels as k

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t|!Zß", max_size=40)), max_size=8)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 20))
def test_tokens_match_split(texts, size):
    got = []
    for b in k.blocks(pa.array(texts, pa.string()), size):
        t = k.tokenise(b, k.SPACES)
        h = k.token_hashes(b, t)
        for i in range(b.last - b.first):
            lo, hi = t.bounds[i], t.bounds[i + 1]
            got.append([(bytes(b.data[s:e]), int(x)) for s, e, x in zip(t.start[lo:hi], t.end[lo:hi], h[lo:hi], strict=True)])
    assert [[w for w, _ in row] for row in got] == [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", x or "")] for x in texts]
    seen = {}
    for row in got:
        for w, x in row:
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_windows_depend_on_content_only():
    h = k.seeded(5, 1)
    x = np.concatenate([h, h, h[:2]])
    w = k.window_hashes(x, 4)
    assert w[0] == w[5] and w[1] == w[6] and len(set(w[:5].tolist())) == 5
    assert k.window_hashes(h, 9).size == 0


@given(st.lists(st.integers(0, 99), max_size=30), st.integers(1, 9))
def test_sliding_min(xs, width):
    got = k.sliding_min(np.array(xs, np.int64), width).tolist()
    assert got == [min(xs[i : i + width]) for i in range(len(xs) - width + 1)]
