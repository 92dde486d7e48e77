"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    a, b = ordered(df.columns, df.collect()), ordered(relation.columns, relation.fetchall())
    assert len(a) == len(b)
    assert repr(a).replace(".0,", ",").replace(".0)", ")") == repr(b).replace(".0,", ",").replace(".0)", ")")
