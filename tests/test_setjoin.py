"""The similarity join of bags against all pairs."""

import random

import pytest

from quern.operators import setjoin


def overlap(a, b):
    high = sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys()) / high if high else 1.0


def some_bags(seed, n=120):
    """Families of edited bags, copies of a hot one, odd ones."""
    r, out = random.Random(seed), []
    for _ in range(n // 6):
        base = {f"t{r.randrange(30)}": r.randrange(1, 12) for _ in range(r.randrange(1, 12))}
        for _ in range(5):
            bag = dict(base)
            for _ in range(r.randrange(4)):
                k = r.choice([*bag, "new"])
                bag[k] = max(0, bag.get(k, 0) + r.choice([-1, 1]))
            out.append(bag)
    return out + [{"p": 10, "a": 3}] * (n // 4) + [None, {}, {"x": 0}, {"x": 1}, {"y": 1}, {"x": 1, "y": 0}, {"big": 400}, {"big": 401}, {"big": 440}]


@pytest.mark.parametrize("seed, least", [(1, 0.9), (2, 0.8), (3, 0.5), (4, 1.0), (5, 0.05)])
def test_all_pairs(spark, seed, least):
    bags = some_bags(seed)
    got = {x["i"]: x for x in setjoin.similar(spark.createDataFrame(list(enumerate(bags)), "i long, bag map<string,int>").repartition(3), "i", "bag", least).collect()}
    clean = [{k: v for k, v in (b or {}).items() if v} for b in bags]
    assert len(got) == len(bags)
    for i, a in enumerate(clean):
        same = [j for j, b in enumerate(clean) if a == b]
        sims = [overlap(a, b) for b in clean if a != b]
        near = [s for s in sims if s >= least]
        x = got[i]
        assert (x["copies"], x["n_similar"]) == (len(same), len(same) - 1 + len(near)), (i, a)
        assert (x["best"] is None) == (not near) and (not near or x["best"] == pytest.approx(max(near)))


def test_plan_and_pruning(spark):
    """No cross join, and few of the pairs are candidates."""
    bags = some_bags(7, 600)
    rows = spark.createDataFrame(list(enumerate(bags)), "i long, bag map<string,int>")
    _, one = setjoin.bags(rows, "i", "bag")
    found = setjoin.candidates(setjoin.prefixes(one.where("size > 0"), 0.9), 0.9)
    n = one.count()
    assert found.count() < n * n / 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_nothing_and_nonsense(spark):
    rows = spark.createDataFrame([], "i long, bag map<string,int>")
    assert setjoin.similar(rows, "i", "bag", 0.9).count() == 0
    with pytest.raises(ValueError):
        setjoin.similar(rows, "i", "bag", 0)
