import random

import numpy as np
import pytest

from ionquarry.llm import bytesops as B


@pytest.mark.parametrize("size", [1, 3, 16, 100])
def test_words_of_long_texts_by_blocks(size):
    r = random.Random(size)
    texts = ["".join(r.choice("aB é\n9") for _ in range(r.randrange(60))) for _ in range(12)] + ["", "x" * 150, " ", "y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for kind in (B.ALNUM, B.NONSPACE):
        whole, blocks = B.word_hashes(data, at, kind), B.word_hashes(data, at, kind, size)
        assert all((a == b).all() for a, b in zip(whole, blocks, strict=True))
