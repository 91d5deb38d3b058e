"""Comparison helper of the operator tests."""


def key(r):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
