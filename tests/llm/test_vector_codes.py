"""Product codes against rounds in full, and what the bounds save."""

import math

import numpy as np
import pytest

from timeloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def in_full(rows, parts, entries, rounds):
    """Codes and errors by every distance in every round, in Python's whole numbers."""
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v in kept), default=0)
    each = -(-longest // parts)
    whole = [[math.floor(1024 * x) for x in v] + [0] * (each * parts - len(v)) for _, v in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    cut = lambda v: [tuple(v[p * each : (p + 1) * each]) for p in range(parts)]
    books = [[cut(whole[i])[p] for i in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (dist(x, books[p][e]), e)) for p, x in enumerate(cut(v))] for v in whole]
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [cut(v)[p] for v, c in zip(whole, codes) if c[p] == e]
                    if own:
                        books[p][e] = tuple(sum(xs) // len(own) for xs in zip(*own))
    errors = [sum(dist(x, books[p][c[p]]) for p, x in enumerate(cut(v))) for v, c in zip(whole, codes)]
    return sorted(((i, c, e) for (i, _), c, e in zip(kept, codes, errors)), key=repr), books


@pytest.mark.parametrize("shape", ["clustered", "plain", "ties"])
def test_rounds_in_full(spark, shape):
    rng = np.random.default_rng(3)
    if shape == "clustered":
        v = (rng.normal(size=(12, 8))[rng.integers(0, 12, 400)] + rng.normal(size=(400, 8)) / 40).astype(np.float32)
    elif shape == "plain":
        v = rng.normal(size=(300, 8)).astype(np.float32)
    else:  # few whole values: many equal distances and equal entries
        v = rng.integers(-2, 3, (300, 8)).astype(np.float32) / 512
    rows = [(i // 2 if shape == "ties" else i, x, None) for i, x in enumerate(v.tolist())]
    coded, books = V.product_codes(spark.createDataFrame(rows, SCHEMA).repartition(5), parts=4, entries=20, rounds=4)
    want, last = in_full(rows, 4, 20, 4)
    assert sorted(((r.vec_id, list(r.code), r.error) for r in coded.collect()), key=repr) == want
    assert [[tuple(e) for e in p.tolist()] for p in books.entries[-1]] == last


def test_bounds_spare_distances():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (32, 8))
    x = centres[rng.integers(0, 32, 4000)] + rng.integers(-30, 30, (4000, 8))
    books = V.Codebooks([[x[:64]]], [V.entry_groups(x[:64], 8)])
    state, drift_only = None, 0
    for _ in range(5):
        a = V.Assigner(books, 0)
        state = a(x, *(state or a.fresh(x)))
        assert (state[0] == V.squared(x, books.entries[-1][0]).argmin(1)).all()
        moved = books.entries[-1][0].copy()
        for e in np.unique(state[0]):
            moved[e] = x[state[0] == e].sum(0) // (state[0] == e).sum()
        books = V.Codebooks([*books.entries, [moved]], books.groups)
    assert a.scanned < 0.35 * len(x) * 64
    # a net displacement never exceeds the sum of the steps, and is shorter where entries turn
    steps = [np.sqrt(V.paired(books.entries[t + 1][0], books.entries[t][0])) for t in range(5)]
    net = np.sqrt(V.paired(books.entries[5][0], books.entries[0][0]))
    assert (net <= sum(steps) + 1e-9).all() and (net < 0.99 * sum(steps)).any()


def test_poor_rows(spark):
    rows = [(3, [1.0, -0.0001, 0.5], 1), (1, [0.0, 0.0, 0.0, 0.0, 0.0], None), (None, [2.0], None), (1, [], 2), (2, None, 1), (4, [1.0, None], 1), (5, [float("nan")], 1), (6, [float("inf")], 1), (1, [3e38, -3e38], 2), (7, [float(2**25)] * 5, 3)]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", code string")
    coded, _ = V.product_codes(table, entries=4, rounds=2)
    want, _ = in_full(rows, 4, 4, 2)
    got = sorted(((r.vec_id, list(r.code), r.error) for r in coded.collect()), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == [w[2] if w[2] < 2**63 else None for w in want]
    empty, books = V.product_codes(table.limit(0))
    assert empty.collect() == [] and "label" in empty.columns and books.digest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    only, _ = V.product_codes(table.where("embedding is null"))
    assert only.count() == 0


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    df = V.op11_norm_of_sum_codes(spark, sf)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(V.OP11_SQL).fetchall())
