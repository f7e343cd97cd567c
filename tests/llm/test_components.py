from tarn.llm.components import components


def slow(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_shapes(spark, rng):
    chain = [(i, i + 1) for i in range(-60, -20)]
    star = [(1000, i) for i in range(100, 160)]
    ring = [(i, 200 + (i - 199) % 30) for i in range(200, 230)]
    loose = [(int(a), int(b)) for a, b in rng.integers(300, 900, (250, 2)) if a != b]
    big = [(2**63 - 1, -(2**63)), (7, 8), (8, 7), (7, 8)]
    links = chain + star + ring + loose + big
    got = components(spark.createDataFrame(links + [(5, 5)], "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.label for r in got} == slow(links)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
