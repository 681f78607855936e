"""Text and JSON renderings of small results (tens of rows)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def render(df: DataFrame, title: str, most: int = 200) -> str:
    """A result as an aligned text table of ``most`` rows; its last line says so where there are more."""
    found = df.limit(most + 1).collect()
    rows = [[("-" if v is None else str(v)) for v in r] for r in found[:most]]
    table = [df.columns, *rows]
    widths = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in table]
    more = [f"... only the first {most} rows are shown"] if len(found) > most else []
    return "\n".join([title, "=" * len(title), lines[0], "-" * len(lines[0]), *lines[1:], *more])


def as_json(df: DataFrame) -> str:
    """All rows of a small result."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], default=str, ensure_ascii=False, sort_keys=True)
