import numpy as np
import pytest

from lodestone.llm import components
from lodestone.llm.common import cut


def brute_roots(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("kind", ["hub", "hubs that meet", "hub above", "random", "clique"])
def test_hubs_and_random_graphs(spark, monkeypatch, kind):
    """Hubs are rows of many tasks; parts of a hub's rows must agree on its smallest neighbour."""
    monkeypatch.setattr(components, "HOT", 5)
    rng = np.random.default_rng(4)
    pairs = {
        "hub": [(0, i) for i in range(1, 400)],
        "hubs that meet": [(500, i) for i in range(300)] + [(501, i) for i in range(299, 480)] + [(900, 901)],
        "hub above": [(1000, i) for i in range(400)] + [(1000 + i, i) for i in range(40)],
        "random": rng.integers(0, 900, (700, 2)).tolist(),
        "clique": [(i, j) for i in range(40) for j in range(i)] + [(39, 70), (70, 71)],
    }[kind]
    pairs = pairs + pairs[:50] + [(v, u) for u, v in pairs[:50]]
    got = components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert len(got) == len({r.u for r in got}) and {r.u: r.root for r in got} == brute_roots(pairs)


def test_shuffles_of_a_round(spark):
    """Shuffle files stay until the driver collects its garbage, so their number is what a long run takes of the disk."""
    e = cut(spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long"))
    made = spark.sparkContext._jsc.sc().newShuffleId
    rounds, keep = [], components.cut
    components.cut = lambda df: rounds.append(1) or keep(df)
    try:
        before = made()
        assert components.connected_components(e).count() == 60
        shuffles = made() - before - 1
    finally:
        components.cut = keep
    assert len(rounds) > 3 and shuffles <= 6 * len(rounds) + 2, (shuffles, len(rounds))
