"""One text in some against the corpus: brute force with common prints, and no shuffle of words or prints."""

import random

from gradeloom.operators import corpus
from gradeloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_scores_with_common_prints_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, ("The one and only line of all that stands in half of them " if i % 2 else "") + " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(60, None), (61, "")]
    sets = {i: corpus.prints(t.lower() if t is not None else None) for i, t in rows}
    common = {h for s in sets.values() for h in s if sum(h in x for x in sets.values()) >= 24}
    assert common
    sets = {i: s - common for i, s in sets.items()}
    want = sorted((a, b, len(x & y) / len(x | y)) for a, x in sets.items() if a % 3 == 0 for b, y in sets.items() if a != b and x & y)
    got = corpus.pair_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), every=3)
    assert sorted(map(tuple, got.collect())) == want and want


def test_nothing_is_shuffled(spark):
    plan = catalog.queries()["j18_one_vs_corpus"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
