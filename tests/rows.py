"""Comparison of result rows whatever their order."""

import math
from collections import Counter


def cell(x):
    if x is None or str(x) in ("<NA>", "nan", "NaT"):
        return None
    if isinstance(x, float):
        return f"{x:.9g}" if not math.isfinite(x) or x != int(x) or abs(x) > 1e15 else str(int(x))
    if hasattr(x, "tolist"):
        return str(x.tolist())
    return str(x)


def bag(frame):
    columns = sorted(frame.columns)
    return columns, Counter(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False, name=None))
