import random

from folium.operators import entities
from folium.operators.components import connected_components


def brute(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    real = [(a, b) for a, b in edges if a is not None]
    want = brute({x for e in real for x in e}, real)
    assert got == {n: r for n, r in want.items() if n != r}
    assert connected_components(df.where("u > 999")).collect() == []


def test_entity_clusters(spark):
    rnd = random.Random(2)
    vocab = ["five", "laws", "bates", "search", "need", "wilson", "need2", "kuhl"]
    rows = [(i, sorted(rnd.sample(vocab, rnd.randint(1, 4)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, toks array<string>")
    generic = ["search", "need"]
    edges = []
    for i, x in rows:
        for j, y in rows:
            a, b = set(x), set(y)
            if i != j and len(a) >= 2 and len(b) >= 2 and a <= b and len(b - a) <= 1 and not a <= set(generic):
                edges.append((i, j))
    want = brute([i for i, _ in rows], edges)
    assert {r.id: r.cluster for r in entities.clusters(df, generic).collect()} == want


def test_merge(spark):
    rows = [(1, 1, 4, "long body", "A", ["x"]), (2, 1, 2, "b", "B", ["y"]), (3, 3, 1, "c", "C", [])]
    df = spark.createDataFrame(rows, "id int, cluster int, score int, body string, title string, aliases array<string>")
    got = {r.cluster: (r.id, r.title, r.aliases) for r in entities.merge_clusters(df).collect()}
    assert got == {1: (1, "A", ["B", "x", "y"]), 3: (3, "C", [])}
