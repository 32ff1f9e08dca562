"""pandas frames whose nullable integers stay integers."""

from __future__ import annotations

import pandas as pd


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """rows under a schema such as "id long, text string"; longs may be None."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pd.DataFrame({n: pd.array(list(c), dtype="Int64") if kind == "long" else pd.Series(list(c), dtype=object) if kind in ("string", "binary") else pd.Series(list(c)) for (n, kind), c in zip(fields, columns, strict=True)})
