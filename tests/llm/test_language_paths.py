"""The paths of languages against plain Viterbi."""

from __future__ import annotations

import numpy as np

from ledgerfold.llm.langid import SWITCH, _paths


def viterbi(s):
    value, back = s[0].copy(), []
    for row in s[1:]:
        top = value.argmax()
        stay = value >= value[top] - SWITCH
        back.append(np.where(stay, np.arange(len(row)), top))
        value = np.where(stay, value, value[top] - SWITCH) + row
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_a_path_that_never_visits_the_favourite():
    s = np.array([[0.0, -2.9, -6.0]] * 5 + [[-6.0, -2.9, 0.0]] * 5)
    assert _paths(s, np.array([0, 10])).tolist() == viterbi(s) == [0] * 5 + [2] * 5


def test_random_scores():
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(400):
        n = rng.integers(1, 25)
        lean = np.repeat(rng.uniform(-4, 0, (n // 5 + 1, 4)), 5, axis=0)[:n]
        texts.append(lean + rng.uniform(-1, 0, (n, 4)))
    of = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert _paths(np.vstack(texts), of).tolist() == [x for t in texts for x in viterbi(t)]
