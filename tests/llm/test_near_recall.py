"""Near duplicates are sets of shingles: repeats do not count, short texts do."""

import numpy as np
import pytest

from tierlens.llm.shingles import shingle_hashes
from tierlens.llm.simhash_dedup import drop_near_duplicates


def pairs_of(kind, n=150):
    rng = np.random.default_rng(len(kind))
    vocabulary = np.array([f"w{i}" for i in range(20_000)])
    for _ in range(n):
        body, line = " ".join(rng.choice(vocabulary, 200)), " ".join(rng.choice(vocabulary, 10))
        if kind == "line 20 times":
            yield body, "\n".join([body] + [line] * 20)
        elif kind == "line 2 or 20 times":
            yield "\n".join([body] + [line] * 2), "\n".join([body] + [line] * 20)
        else:
            words = rng.choice(vocabulary, 9)
            yield " ".join(words[:8]), " ".join(words)


@pytest.mark.parametrize("kind,least", [("line 20 times", 0.99), ("line 2 or 20 times", 1.0), ("8 or 9 words", 0.97)])
def test_recall(spark, kind, least):
    pairs = list(pairs_of(kind))
    for a, b in pairs[:5]:
        a, b = (set(shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
        assert len(a & b) >= 0.8 * len(a | b)
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    left = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(len(pairs))} <= left
    lost = len(left) - len(pairs)
    print(kind, "recall", 1 - lost / len(pairs))
    assert lost <= (1 - least) * len(pairs)
