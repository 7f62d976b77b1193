"""Stateful stream operators whose meaning is sequential per key. State is a few values per key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedupe_stream(stream: DataFrame, key: str, order: str, width: int) -> DataFrame:
    """key, order, delivered: false within ``width`` of the key's last delivered row. Skips don't extend the window.

    As ``sinks.dedupe_window``, for rows that arrive in order per key across micro-batches.
    """
    rows = stream.select(F.col(key).cast("string").alias("k"), F.col(order).cast("long").alias("seq"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor = state.get[0] if state.exists else None
        g = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for s in g["seq"]:
            ok = anchor is None or s - anchor >= width
            anchor = int(s) if ok else anchor
            out.append(ok)
        state.update((anchor,))
        yield g.assign(delivered=out)

    return rows.groupBy("k").applyInPandasWithState(step, "k string, seq long, delivered boolean", "anchor long", "append", GroupStateTimeout.NoTimeout)


def hydrate_stream(stream: DataFrame, key: str, order: str, columns: dict[str, str], op: str = "op") -> DataFrame:
    """key, order, op and the columns as text, those a row lacks filled from the key's last image; a delete forgets it."""
    rows = stream.select(F.col(key).cast("string").alias("k"), F.col(order).cast("long").alias("seq"), F.col(op).alias("op"), *[F.col(c).cast("string").alias(c) for c in columns], *[F.col(p).alias(f"has_{i}") for i, p in enumerate(columns.values())])
    fields = ", ".join(f"{c} string" for c in columns)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        image = json.loads(state.get[0]) if state.exists else {}
        g = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for r in g.to_dict("records"):
            if r["op"] == "delete":
                image = {}
                out.append({c: None for c in columns})
                continue
            image |= {c: None if pd.isna(r[c]) else r[c] for i, c in enumerate(columns) if r[f"has_{i}"]}
            out.append({c: image.get(c) for c in columns})
        state.update((json.dumps(image),))
        yield pd.DataFrame({"k": g["k"].to_list(), "seq": g["seq"].to_list(), "op": g["op"].to_list()} | {c: [o[c] for o in out] for c in columns})

    return rows.groupBy("k").applyInPandasWithState(step, f"k string, seq long, op string, {fields}", "image string", "append", GroupStateTimeout.NoTimeout)
