import numpy as np

from loreforge.llm import suffix_tree


def test_unseen_words_share_what_seen_ones_leave():
    n, v = 4_000_000, 400_000
    seen = np.array([n - v + 1] + [1] * (v - 1), np.float64)
    spelled = np.full(v, -np.inf)
    with np.errstate(divide="ignore"):
        mine = 10 ** suffix_tree.token_score(seen, spelled, n, v)
    # All unseen spellings together have a chance of one in the tree at most.
    unseen = 10 ** suffix_tree.token_score(np.zeros(1000), np.full(1000, -3.0), n, v)
    assert np.isclose(mine.sum() + unseen.sum(), 1, rtol=1e-9)


def test_letters_of_unseen_words_and_what_stands_before_a_word_count():
    likely, unlikely = suffix_tree.token_score(np.zeros(2), np.array([-8.0, -20.0]), 4_000_000, 400_000)
    assert np.isclose(likely - unlikely, 12)
    a, b = suffix_tree.token_score(np.array([50.0, 50.0]), np.array([-2.0, -6.0]), 4_000_000, 400_000)
    assert a > b + 1
