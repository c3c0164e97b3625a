"""Local scores from seeds against the full recurrence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixweave.functions import kernels as K
from helixweave.functions import seeds
from helixweave.functions.scoring import Edges, Scores
from helixweave.operators import align


def full(a, b, sc=Scores()):
    return K.best_scores([x for x in a for _ in b], [y for _ in a for y in b], Edges(), sc)[:, 0].reshape(len(a), len(b))


@pytest.mark.parametrize("most", [4_000_000, 50])
@pytest.mark.parametrize("sc", [Scores(), Scores(2, -3, 5, 2), Scores(1, -1, 0, 1), Scores(1, -2, 2, 1), Scores(1, -9, 2, 1)])
def test_scores_from_seeds_equal_the_recurrence(sc, most, monkeypatch):
    rng = random.Random(str(sc))
    monkeypatch.setattr(seeds, "MOST", most)
    for t in range(60):
        word = lambda n, k=1 + t % 6: "".join(rng.choice("ABCDÉ𝄞"[:k]) for _ in range(rng.randint(0, n)))
        a, b = [word(40) for _ in range(rng.randint(1, 5))], [word(60) for _ in range(rng.randint(0, 9))]
        for x in a:  # near copies with gaps and mismatches
            y = list(word(9) + x + word(9))
            for _ in range(rng.randint(0, 4)):
                at = rng.randint(0, len(y))
                y[at : at + rng.choice([0, 1, 3])] = word(2)
            b.append("".join(y))
        a, b = ([K.codes(s) for s in side] for side in (a, b))
        assert (seeds.local_scores(a, b, sc) == full(a, b, sc)).all()


def test_few_cells_of_unlike_texts_are_followed(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = ([rng.integers(0, 40, 400).astype(np.int32) for _ in range(100)] for _ in range(2))
    # 1.6e9 cells; the recurrence takes minutes, seeds follow a few thousand of them at a time
    monkeypatch.setattr(seeds, "MOST", 5_000)
    monkeypatch.setattr(K, "best_scores", lambda *a: pytest.fail("computed in full"))
    assert seeds.local_scores(a, b).shape == (100, 100)


def test_scores_of_all_texts_with_all_items(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ABCD") for _ in range(n))
    texts = [(i, word(rng.randint(0, 90))) for i in range(50)] + [(k, "SAME TEXT") for k in range(60, 80)] + [(90, None), (91, ""), (60, "OTHER")]
    items = [(i, word(rng.randint(0, 50))) for i in range(9)] + [(20, "AME"), (21, "AME"), (22, ""), (23, None)]
    left = spark.createDataFrame(texts, "doc long, b string").withColumn("g", F.lit(1))
    right = spark.createDataFrame(items, "item_id long, a string")
    want = sorted((d, 1, i, int(full([K.codes(a)], [K.codes(b)])[0, 0])) for d, b in texts for i, a in items if a is not None and b is not None)
    for chars in (40, 250_000):
        monkeypatch.setattr(align, "BLOCK_CHARS", chars)
        got = align.local_scores_of_all(left, right)
        assert got.columns == ["doc", "g", "item_id", "score"] and sorted(map(tuple, got.collect())) == want
    assert align.local_scores_of_all(left.limit(0), right).count() == align.local_scores_of_all(left, right.limit(0)).count() == 0
