"""Group texts are gathered from one array of names, and stretches of any length are walked to their end."""

from __future__ import annotations

import numpy as np

from partition_audit.llm import token_alignment as al


def test_group_text_takes_both_tokenizers_names_from_one_array():
    named = al.names(12, 9)
    assert isinstance(named, np.ndarray) and len(named) == 2 * (12 + 9)
    a, b = np.array([11, 0, 3, 7]), np.array([8, 0, 2])
    last_a, last_b = np.array([1, 3]), np.array([0, 2])
    assert al.group_text(a, b, last_a, last_b, named, 12, 9) == "11,0|8;3,7|0,2"


def test_stretches_of_every_length():
    for n in range(1, 70):
        for tail in ([], [1000]):
            a, b = [*range(n), *tail], [*range(n), *(x + 1 for x in tail)]
            assert al.common_ends(a, b) == [(0, 0, n)]
