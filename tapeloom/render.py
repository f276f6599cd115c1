"""Price charts of a few hundred bars as SVG, pages of them, and the charts of a search's matches; drawn by the driver from bounded rows."""

import html
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.bars import numbered, period_end, resample

UP, DOWN, LINES = "#c0392b", "#1e8449", ("#34495e", "#8e44ad", "#d68910")


def price_axis(*charts: Sequence[dict]) -> tuple[float, float]:
    """Lowest and highest price of several charts, for a shared axis."""
    return min(b["low"] for bars in charts for b in bars), max(b["high"] for bars in charts for b in bars)


def chart(bars: Sequence[dict], title: str, width: int = 960, height: int = 480, marks: dict | None = None, averages: Sequence[str] = ("ma5", "ma10", "ma20"), bands: Sequence[tuple] = (), axis: tuple[float, float] | None = None) -> str:
    """Candles on a logarithmic scale with volumes and averages; ``marks`` labels bars by date, ``bands`` shades spans of dates,
    ``axis`` is the price range to draw where several charts share one."""
    if not bars:
        raise ValueError("no bars to draw")
    low, high = map(math.log, axis or price_axis(bars))
    top, base, floor = 40, height * 0.72, height - 30
    step = (width - 80) / len(bars)
    x = lambda i: 60 + step * (i + 0.5)
    y = lambda p: base - (math.log(p) - low) / max(high - low, 1e-9) * (base - top)
    most = max((b.get("vol") or 0 for b in bars), default=0) or 1
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" font-family="sans-serif" font-size="12">', f'<text x="60" y="22" font-size="16">{html.escape(title)}</text>']
    for first, last in bands:
        inside = [i for i, b in enumerate(bars) if first <= b["date"] <= last]
        if inside:
            out.append(f'<rect class="band" x="{x(inside[0]) - step / 2:.1f}" y="{top}" width="{step * (inside[-1] - inside[0] + 1):.1f}" height="{floor - top}" fill="#f9e79f" opacity="0.5"/>')
    for k in range(5):
        p = math.exp(low + (high - low) * k / 4)
        out.append(f'<line x1="60" x2="{width - 20}" y1="{y(p):.1f}" y2="{y(p):.1f}" stroke="#ddd"/><text x="4" y="{y(p) + 4:.1f}">{p:.2f}</text>')
    for i, b in enumerate(bars):
        color = UP if b["close"] >= b["open"] else DOWN
        a, z = sorted((y(b["open"]), y(b["close"])))
        out.append(f'<line x1="{x(i):.1f}" x2="{x(i):.1f}" y1="{y(b["high"]):.1f}" y2="{y(b["low"]):.1f}" stroke="{color}"/><rect x="{x(i) - step * 0.35:.1f}" y="{a:.1f}" width="{step * 0.7:.1f}" height="{max(z - a, 1):.1f}" fill="{color}"/>')
        tall = (b.get("vol") or 0) / most * (floor - base - 20)
        out.append(f'<rect x="{x(i) - step * 0.35:.1f}" y="{floor - tall:.1f}" width="{step * 0.7:.1f}" height="{tall:.1f}" fill="{color}" opacity="0.5"/>')
        if marks and b["date"] in marks:
            out.append(f'<text x="{x(i):.1f}" y="{y(b["high"]) - 6:.1f}" text-anchor="middle">{html.escape(str(marks[b["date"]]))}</text>')
    for name, color in zip(averages, LINES, strict=False):
        points = " ".join(f"{x(i):.1f},{y(b[name]):.1f}" for i, b in enumerate(bars) if b.get(name))
        if points:
            out.append(f'<polyline fill="none" stroke="{color}" points="{points}"/>')
    out.append(f'<text x="60" y="{height - 8}">{bars[0]["date"]}</text><text x="{width - 100}" y="{height - 8}">{bars[-1]["date"]}</text></svg>')
    return "".join(out)


def page(title: str, sections: Sequence[tuple[str, Sequence[str]]]) -> str:
    """An HTML page: sections of a heading and charts, that fits narrow screens."""
    body = "".join(f"<h2>{html.escape(name)}</h2>" + "".join(f"<figure>{c}</figure>" for c in charts) for name, charts in sections)
    style = "body{font-family:sans-serif;max-width:1000px;margin:auto;padding:8px}figure{margin:8px 0}svg{width:100%;height:auto}"
    return f'<!doctype html><html><head><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'


def match_charts(bars: DataFrame, matches: DataFrame, most: int = 20, daily: int = 90, others: int = 22) -> list[tuple[str, list[str]]]:
    """Sections for :func:`page`: of each of the first ``most`` matches (rank, ts_code, start_date, end_date, score) a daily, a
    weekly and a monthly chart, from so many bars before the window to so many behind it, the window shaded.

    Only the matches' instruments are read, and a bounded number of bars a match comes to the driver."""
    found = matches.orderBy("rank").limit(most).select("rank", "ts_code", "start_date", "end_date", "score").collect()
    own = bars.filter(F.col("ts_code").isin(sorted({r.ts_code for r in found})))
    out = [(f"{r['rank']}. {r.ts_code} {r.start_date} to {r.end_date}, score {r.score:.4f}", []) for r in found]
    spans = own.sparkSession.createDataFrame([(k, r.ts_code, r.start_date, r.end_date) for k, r in enumerate(found)], "k int, ts_code string, a date, z date")
    for period, around in (("D", daily), ("W", others), ("M", others)):
        frame = numbered(own if period == "D" else resample(own, period))
        last = F.col("z") if period == "D" else period_end(F.col("z"), period)
        near = frame.join(F.broadcast(spans), "ts_code")
        inside = F.col("date").between(F.col("a"), last)
        edges = near.filter(inside).groupBy("k").agg(F.min("bar_no").alias("first"), F.max("bar_no").alias("last"))
        shown = near.join(F.broadcast(edges), "k").filter(F.col("bar_no").between(F.col("first") - around, F.col("last") + around))
        ends = {r.k: str(r.end) for r in spans.select("k", last.alias("end")).collect()}
        rows: dict[int, list] = {}
        for r in shown.select("k", F.col("date").cast("string").alias("date"), "open", "high", "low", "close", "vol").orderBy("k", "date").collect():
            rows.setdefault(r.k, []).append(r.asDict())
        for k, mine in rows.items():
            out[k][1].append(chart(mine, f"{found[k].ts_code} {period}", averages=(), bands=[(str(found[k].start_date), ends[k])]))
    return out
