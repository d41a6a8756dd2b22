import random

from tests.llm.helpers import union_all
from vendora.llm.components import components


def test_paths_stars_and_random_graphs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(70)]
    edges += [(5, 4), (7, 7), (100, 100), (-3, 9), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    names = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(names)}
    want = union_all(len(names), [(at[a], at[b]) for a, b in edges])
    assert all(got.get(x, x) == names[want[at[x]]] for x in names)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
