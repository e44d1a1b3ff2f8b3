import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trailhead.llm import suffixes


def brute(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=60))
def test_small_alphabets(t):
    assert suffixes.suffix_array(np.array(t, np.int16), 4).tolist() == brute(t)


def test_texts_with_repeats():
    rng = np.random.default_rng(1)
    for n, sigma in ((1, 3), (2, 2), (500, 2), (3000, 257), (3000, 5)):
        t = rng.integers(0, sigma, n).astype(np.int16)
        if n >= 500:
            t[n // 2 : n // 2 + 200] = t[:200]
            t[300:400] = 1
        assert suffixes.suffix_array(t, sigma).tolist() == brute(t.tolist())


def test_permuted_prefixes():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[2000:2600] = text[100:700]
    sa = suffixes.suffix_array(text.astype(np.int16), 257)
    counted = np.zeros(4000, bool)
    counted[:3900] = rng.random(3900) < 0.95
    got = suffixes.permuted_prefixes(text, sa, 100, counted)
    b = text.tobytes()
    for j in range(1, len(sa)):
        i, k = int(sa[j]), int(sa[j - 1])
        want = 0
        if counted[i] and counted[k]:
            while want < 100 and b[i + want] == b[k + want]:
                want += 1
        assert got[i] == want
