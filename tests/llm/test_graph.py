import random

import pytest

from odarel.llm.graph import components
from odarel.llm.shared import materialize, release
from tests.llm import brute


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 300)], "random"])
def test_components(spark, edges):
    if edges == "random":
        rng = random.Random(1)
        edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == brute.classes(nodes, [e for e in edges if e[0] != e[1]])


def test_release(spark):
    df = materialize(spark.range(5), "t")
    assert df.count() == 5
    release(spark)
    with pytest.raises(Exception):
        df.count()
