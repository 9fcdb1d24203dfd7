"""Finite-state scans: the state of each row of a run, where a row's step depends on the state before it.

Over a few states a row is a map from the state before it to the one after it, and maps compose. So ranges of a run are folded to
one map each, alone; one row a range is scanned by run; and each range is replayed from the state that it starts in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of the order that make a range: about a minute of a scanner's packets.
SPAN = 100_000


def prefixes(moves: np.ndarray) -> np.ndarray:
    """[i, state] where the moves up to i lead to, for moves [i, state]: by doubling, so in log2 of the rows whole-array steps."""
    out, step = moves.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].copy(), axis=1)
        step *= 2
    return out


def whole_move(moves: np.ndarray) -> np.ndarray:
    """Where all moves together lead: neighbours are composed until one is left."""
    while len(moves) > 1:
        paired = np.take_along_axis(moves[1::2], moves[: len(moves) // 2 * 2 : 2], axis=1)
        moves = np.concatenate([paired, moves[-1:]]) if len(moves) % 2 else paired
    return moves[0]


def finite_scan(rows: DataFrame, moves: Column, order: str, key: str, start: int, span: int = SPAN) -> DataFrame:
    """(key, order, state): the state after each row of a run, which begins in `start`.

    moves: array<int>, for each state before the row (0, 1, ...) the state after it. order is an integer column, distinct within a key, and
    neither is null. A task holds `span` numbers of the order, or one row for each such range of a run.
    """
    held = rows.select(key, order, F.floor(F.col(order) / span).alias("_span"), moves.alias("_moves"))
    kinds = dict(held.dtypes)

    def table(group: pd.DataFrame, by: str) -> tuple[pd.DataFrame, np.ndarray]:
        group = group.sort_values(by)
        return group, np.stack(group["_moves"].to_numpy()).astype(np.int64)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group, own = table(group, order)
        return pd.DataFrame({key: group[key].iloc[:1], "_span": group["_span"].iloc[:1], "_moves": [whole_move(own).tolist()]})

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group, own = table(group, "_span")
        state = np.concatenate([[start], prefixes(own)[:-1, start]])
        return pd.DataFrame({key: group[key], "_span": group["_span"], "_start": state})

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        group, own = table(group, order)
        return pd.DataFrame({key: group[key], order: group[order], "state": prefixes(own)[:, group["_start"].iloc[0]]})

    ranges = held.groupBy(key, "_span").applyInPandas(fold, f"{key} {kinds[key]}, _span long, _moves array<int>")
    starts = ranges.groupBy(key).applyInPandas(scan, f"{key} {kinds[key]}, _span long, _start int")
    return held.join(starts, [key, "_span"]).groupBy(key, "_span").applyInPandas(replay, f"{key} {kinds[key]}, {order} {kinds[order]}, state int")
