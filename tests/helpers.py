"""Plain-Python twins of the window operators, and table comparison."""

import math
from collections import defaultdict


def rows_of(df, keys):
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    places = [columns.index(k) for k in keys]
    return columns, sorted(rows, key=lambda r: [(r[p] is not None, r[p]) for p in places])


def assert_same(left, right, keys, tolerance=1e-9):
    columns, a = rows_of(left, keys)
    other, b = rows_of(right, keys)
    assert columns == other
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for column, u, v in zip(columns, x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert math.isclose(u, v, rel_tol=tolerance, abs_tol=tolerance), (column, x, y)
            else:
                assert u == v, (column, x, y)


def brute_rolling(rows, group, order, value, start, stop, divisor):
    """Mean and deviation of each row, keyed by the row's index in ``rows``."""
    groups = defaultdict(list)
    for index, row in enumerate(rows):
        groups[group(row)].append((order(row), index))
    result = {}
    for members in groups.values():
        indices = [i for _, i in sorted(members)]
        frames = {
            i: [indices[j] for j in range(max(0, p + start), min(len(indices), p + stop + 1))]
            for p, i in enumerate(indices)
        }
        means = {}
        for i in indices:
            known = [value(rows[j]) for j in frames[i] if value(rows[j]) is not None]
            means[i] = sum(known) / len(known) if known else None
        for i in indices:
            squares = [
                (value(rows[j]) - means[j]) ** 2
                for j in frames[i]
                if value(rows[j]) is not None and means[j] is not None
            ]
            result[i] = (means[i], math.sqrt(sum(squares) / divisor) if squares else None)
    return result
