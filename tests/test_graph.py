from lattica.operators.graph import connected_components


def components(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    return {r.node: r.component for r in connected_components(df).collect()}


def test_path_star_loop_and_nulls(spark):
    got = components(spark, [(9, 8), (8, 7), (7, 3), (20, 21), (20, 22), (20, 23), (5, 5), (None, 4), (4, None), (9, 8)])
    assert got == {9: 3, 8: 3, 7: 3, 3: 3, 20: 20, 21: 20, 22: 20, 23: 20, 5: 5}


def test_long_path(spark):
    got = components(spark, [(i, i + 1) for i in range(60)])
    assert set(got.values()) == {0} and len(got) == 61


def test_empty(spark):
    assert components(spark, []) == {}


def test_contracted_paths_need_few_links(spark, monkeypatch):
    """Three long paths of near numbers leave only the links between ranges; any numbers give the same components."""
    import random

    from lattica.operators import graph as G

    seen = []
    whole = G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda edges, *rest: seen.append(edges.count()) or whole(edges, *rest))
    path = [(i, i + 1) for i in range(3000) if i % 1000 != 999] + [(5000, 5000), (None, 7), (8, None)]
    got = {r.node: r.component for r in G.contracted_components(spark.createDataFrame(path, "src long, dst long")).collect()}
    assert got == {i: i // 1000 * 1000 for i in range(3000)} | {5000: 5000}
    assert sum(seen) < 50
    rng = random.Random(2)
    for links in (60, 150):
        df = spark.createDataFrame([(rng.randrange(200), rng.randrange(200)) for _ in range(links)], "src long, dst long").repartition(5)
        want = {r.node: r.component for r in whole(df).collect()}
        assert {r.node: r.component for r in G.contracted_components(df).collect()} == want
    assert G.contracted_components(spark.createDataFrame([], "src long, dst long")).count() == 0
