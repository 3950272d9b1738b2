import duckdb
import pandas as pd
import pytest

from promptloom.llm import mixing

from .conftest import EDGE


def levels(sizes, weights, total):
    """Shares the excess again and again."""
    target, free, left = {}, dict(sizes), total
    while free:
        w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > 2 * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / w if w else 0 for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left = total - sum(target.values())
        free = {s: sizes[s] for s in free if s not in over}
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1000], [1000, 100, 1], [5], [0, 0, 7], [0, 0], [3, 900, 2, 50, 1, 7]])
def test_targets_equal_the_repeated_sharing(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = levels(dict(zip(names, sizes)), {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, 1.5 * sum(sizes))
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_sources_come_near_their_targets(docs):
    rows = [(i, "w " * (i % 37 + 1), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    got = mixing.mix(docs(*rows)).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.02 * g["target"].iloc[0] + 40
    assert (got["taken"] <= 2 * got["size"]).all() and len(got) == 3000
    again = mixing.mix(docs(*rows[::-1])).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_edge_rows_match_sql(edge):
    got = mixing.mix(edge).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    c = duckdb.connect()
    c.register("documents", pd.DataFrame([(r[0], r[1], r[3]) for r in EDGE], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    cursor = c.execute(mixing.ORACLE_SQL)
    want = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description])[list(got.columns)]
    key = lambda d: sorted(tuple(None if pd.isna(x) else round(float(x), 6) for x in r) + () for r in d.itertuples(index=False) if not pd.isna(r[0]))
    assert key(got) == key(want) and len(got) == len(want)


def test_rows_are_repeated_in_the_columns_of_docs(edge, empty):
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns
    assert out.count() == mixing.mix(edge).agg({"copies": "sum"}).first()[0]
    assert mixing.mix(empty).count() == 0
