"""Shared by the tests; a module of its own, since every folder's conftest has the same module name."""


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
