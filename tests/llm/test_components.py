import random

from tilewright.llm import components as C


def _rows_written(monkeypatch, spark, edges):
    written, stored = [], C.stored

    def counted(df, label):
        out = stored(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(C, "stored", counted)
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    return got, sum(written)


def test_long_chain_writes_rows_in_proportion_to_its_edges(spark, monkeypatch):
    n = 1500
    ids = list(range(n))
    random.Random(5).shuffle(ids)
    got, rows = _rows_written(monkeypatch, spark, list(zip(ids, ids[1:])))
    assert got == dict.fromkeys(range(n), 0)
    assert rows <= 7 * n  # labels of all nodes written in each of a dozen rounds were 11 * n and more


def test_contraction_agrees_with_a_search(spark, monkeypatch):
    r = random.Random(9)
    edges = [(r.randrange(-200, 200), r.randrange(-200, 200)) for _ in range(170)] + [(500, k) for k in range(501, 560)] + [(900, 900), (7, None)]
    near = {}
    for a, b in edges:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    assert _rows_written(monkeypatch, spark, edges)[0] == want


def test_no_edges(spark, monkeypatch):
    assert _rows_written(monkeypatch, spark, [])[0] == {}
