import random

from rimeframe.llm._store import Store
from rimeframe.llm.components import components


def test_components_of_stars_chains_and_random_links(spark):
    rng = random.Random(3)
    chain = list(zip(range(100, 160), range(101, 161)))
    rng.shuffle(chain)
    late = [(200, 299), (201, 299), (199, 201)]  # a star around its largest node
    for edges in ([], [(5, 5)], [(9, i) for i in range(10, 30)], late, chain + late, [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]):
        root = {i: i for e in edges for i in e}
        for _ in root:
            before = dict(root)
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                break
        found = components(Store(spark, "cc"), spark.createDataFrame(edges, "u long, v long"))
        assert sorted(map(tuple, found.collect())) == sorted((n, r) for n, r in root.items() if n != r)
