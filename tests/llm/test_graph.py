import random

from ravelin.llm.graph import components


def test_components_of_chains_hubs_and_cycles(spark):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(100, 140)]  # a chain
    links += [(500, k) for k in range(501, 560)]  # a hub
    links += [(900, 901), (901, 902), (902, 900), (7, 7), (901, 900), (None, 3), (4, None)]
    rng.shuffle(links)
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 500 for k in range(500, 560)}, **{k: 900 for k in (900, 901, 902)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
