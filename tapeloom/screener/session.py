"""Formulas over arrays: the bar-by-bar session, for streams and as a check on the window expressions."""

import numpy as np

from tapeloom.screener.formula import Node, Statement, chosen


def _rolled(name: str, x: np.ndarray, n: int) -> np.ndarray:
    """A window function over the last ``n`` bars, or over all so far for 0."""
    known = ~np.isnan(x)
    true = known & (x != 0)
    seen = np.arange(1, len(x) + 1)
    if name in ("MA", "STD"):
        if n <= 0 or not len(x) or n > len(x):
            return np.full(len(x), np.nan)
        frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)
        if name == "MA":
            return frames.mean(axis=1)
        return frames.std(axis=1, ddof=1) if n > 1 else np.full(len(x), np.nan)
    if name in ("HHV", "LLV"):
        f = np.fmax if name == "HHV" else np.fmin
        if n <= 0:
            return f.accumulate(x) if len(x) else x
        frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)
        return f.reduce(frames, axis=1)

    def total(values: np.ndarray) -> np.ndarray:
        whole = np.concatenate([[0.0], np.cumsum(values)])
        return whole[1:] - (whole[np.maximum(seen - n, 0)] if n > 0 else 0.0)

    count = total(true.astype(float))
    if name == "SUM":
        if n > 0 and len(x):
            frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(n - 1), np.where(known, x, 0.0)]), n)
            return np.where(total(known.astype(float)) > 0, frames.sum(axis=1), np.nan)
        return np.where(np.cumsum(known) > 0, np.cumsum(np.where(known, x, 0.0)), np.nan)
    if name == "COUNT":
        return count
    return (count > 0).astype(float) if name == "EXIST" else (count == (np.minimum(seen, n) if n > 0 else seen)).astype(float)


def _lag(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(len(x) - n, 0)]])


def _truth(x: np.ndarray, *inputs: np.ndarray) -> np.ndarray:
    return np.where(np.any(np.isnan(inputs), axis=0), np.nan, np.asarray(x, float))


def _logic(op: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lost = np.isnan(a) | np.isnan(b)
    yes, no = ((a != 0) & (b != 0), (a == 0) | (b == 0)) if op == "AND" else (((a != 0) & ~np.isnan(a)) | ((b != 0) & ~np.isnan(b)), (a == 0) & (b == 0))
    return np.where(yes & ~(lost & (op == "AND")), 1.0, np.where(no, 0.0, np.nan))


def value_of(node: Node, bars: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> np.ndarray:
    """The node's value at every bar, with NaN for a missing one."""
    go = lambda a: value_of(a, bars, known)
    size = len(bars["close"])
    if node.kind == "number":
        return np.full(size, float(node.value))
    if node.kind == "field":
        return np.asarray(bars[node.value], float)
    if node.kind == "name":
        return known[node.value]
    if node.kind == "unary":
        return -go(node.args[0])
    if node.kind == "binary":
        a, b = map(go, node.args)
        if node.value in ("AND", "OR"):
            return _logic(node.value, a, b)
        if node.value == "/":
            return np.divide(a, b, out=np.full(size, np.nan), where=b != 0)
        if node.value in "+-*":
            return {"+": np.add, "-": np.subtract, "*": np.multiply}[node.value](a, b)
        compare = {">": np.greater, "<": np.less, ">=": np.greater_equal, "<=": np.less_equal, "=": np.equal, "<>": np.not_equal}
        return _truth(compare[node.value](a, b), a, b)
    name, args = node.value, node.args
    if name in ("MA", "STD", "REF", "COUNT", "SUM", "HHV", "LLV", "EVERY", "EXIST"):
        x, n = go(args[0]), int(args[1].value)
        if name == "REF":
            return _lag(x, n)
        return _rolled(name, x, n)
    values = [go(a) for a in args]
    if name == "CROSS":
        a, b = values
        up, before = _truth(a > b, a, b), _truth(_lag(a, 1) <= _lag(b, 1), _lag(a, 1), _lag(b, 1))
        return _logic("AND", up, before)
    if name == "BARSCOUNT":
        return np.cumsum(~np.isnan(values[0])).astype(float)
    if name == "BARSLAST":
        at = np.arange(size, dtype=float)
        hit = np.where((values[0] != 0) & ~np.isnan(values[0]), at, -1.0)
        last = np.maximum.accumulate(hit) if size else hit
        return np.where(last < 0, np.nan, at - last)
    if name == "IF":
        return np.where((values[0] != 0) & ~np.isnan(values[0]), values[1], values[2])
    if name == "NOT":
        return _truth(values[0] == 0, values[0])
    if name in ("MAX", "MIN"):
        return (np.maximum if name == "MAX" else np.minimum)(*values)
    x = values[0]
    return {"ABS": lambda: np.abs(x), "LN": lambda: np.log(np.where(x > 0, x, np.nan)), "SQRT": lambda: np.sqrt(np.where(x >= 0, x, np.nan))}[name]()


def run(statements: list[Statement], bars: dict[str, np.ndarray]) -> np.ndarray:
    known: dict[str, np.ndarray] = {}
    with np.errstate(all="ignore"):
        for s in statements:
            known[s.name] = value_of(s.node, bars, known)
    return known[chosen(statements)]
