"""Features of scan rings: planes, edges and wires, as labels of points."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed codes of labels.
NONE, PLANE_END, PLANE, EDGE_JUMP, EDGE_PLANE, WIRE = range(6)
#: Fixed codes of a neighbour's direction: across the beam, away from the scanner, towards it, beyond reach, too near.
ACROSS, AWAY, TOWARDS, FAR, NEAR = range(5)


@dataclass(frozen=True)
class Limits:
    """Fixed thresholds of the labels. per_metre and base give the length of a plane's piece; jump ratios are of squared gaps for spinning scanners."""

    blind: float = 2.0
    reach: float = 10.0
    group: int = 8
    per_metre: float = 0.01
    base: float = 0.1
    straight: float = 225.0
    uneven: float = 3.24
    uneven_livox: float = 6.25
    fold: float = 0.707
    towards: float = float(np.cos(np.radians(170)))
    away: float = float(np.cos(np.radians(8)))
    bent: float = float(np.cos(np.radians(160)))
    flat: float = float(np.cos(np.radians(172.5)))
    flat_ratio: float = 1.2
    gap: float = 0.0225
    gap_ratio: float = 4.0
    jump_ratio: float = 2.0
    jump: float = 0.1


class Ring:
    """One ring in order: places, planar ranges and gaps to the next point (squared unless livox)."""

    def __init__(self, xyz: np.ndarray, livox: bool, limits: Limits):
        self.xyz, self.livox, self.at, self.n = xyz, livox, limits, len(xyz)
        self.range = np.hypot(xyz[:, 0], xyz[:, 1])
        step = ((xyz[1:] - xyz[:-1]) ** 2).sum(axis=1)
        self.gap = np.append(np.sqrt(step) if livox else step, 0.0)
        self.shown = self.range >= limits.blind
        self.label = np.zeros(self.n, np.int64)

    def piece(self, i: int) -> tuple[int, np.ndarray | None]:
        """(next, direction) of the piece of a plane that starts at i; direction is None if it is none."""
        t = self.at
        far = ((self.xyz[i:] - self.xyz[i]) ** 2).sum(axis=1) >= (t.per_metre * self.range[i] + t.base) ** 2
        far[: t.group] = False
        end = i + int(np.argmax(far)) if far.any() else self.n
        hidden = ~self.shown[i : min(end + 1, self.n)]
        if hidden.any():
            return i + int(np.argmax(hidden)), None
        along = self.xyz[min(end, self.n - 1)] - self.xyz[i]
        across = np.cross(self.xyz[i + 1 : end] - self.xyz[i], along)
        width = (across**2).sum(axis=1).max(initial=0.0)
        if width > 0 and (along @ along) ** 2 / width < t.straight:
            return end, None
        gaps = np.sort(self.gap[i:end])[::-1]
        least, middle = gaps[-2], gaps[len(gaps) // 2]
        if least < 1e-16:
            return end, None
        even = gaps[0] / middle < t.uneven_livox and middle / least < t.uneven_livox if self.livox else gaps[0] / least < t.uneven
        return end, along / np.linalg.norm(along) if even else None

    def planes(self, head: int) -> None:
        i, last = head, None
        while i < self.n - self.at.group:
            if not self.shown[i]:
                i += 1
                continue
            end, direction = self.piece(i)
            if direction is None:
                i, last = end + 1, None
                continue
            stop = min(end, self.n - 1)
            self.label[i + 1 : stop] = PLANE
            self.label[[i, stop]] = PLANE_END
            if last is not None:
                self.label[i] = EDGE_PLANE if abs(last @ direction) < self.at.fold else PLANE
            i, last = max(end, i + 1), direction

    def edges(self, head: int) -> np.ndarray:
        """Labels jumps and wires, and gives the cosine between the directions to both neighbours (2 where it isn't looked at)."""
        t, i = self.at, np.arange(head + 3, self.n - 3)
        cosine = np.full(self.n, 2.0)
        i = i[self.shown[i] & (self.label[i] < PLANE) & (self.gap[i - 1] >= 1e-16) & (self.gap[i] >= 1e-16)] if len(i) else i
        if not len(i):
            return cosine
        ways, codes = [], []
        with np.errstate(divide="ignore", invalid="ignore"):
            for m in (-1, 1):
                way = np.where(self.shown[i + m, None], self.xyz[i + m] - self.xyz[i], np.nan)
                a = (self.xyz[i] * way).sum(axis=1) / np.linalg.norm(self.xyz[i], axis=1) / np.linalg.norm(way, axis=1)
                code = np.where(a < t.towards, TOWARDS, np.where(a > t.away, AWAY, ACROSS))
                codes.append(np.where(self.shown[i + m], code, np.where(self.range[i] > t.reach, FAR, NEAR)))
                ways.append(way)
            cosine[i] = (ways[0] * ways[1]).sum(axis=1) / np.linalg.norm(ways[0], axis=1) / np.linalg.norm(ways[1], axis=1)

        def smooth(side: int) -> np.ndarray:
            """The two gaps on one side (0 before, 1 after) are alike and shown."""
            first, second = (i - 1, i - 2) if side == 0 else (i, i + 1)
            seen = self.shown[i - 1] & self.shown[i - 2] if side == 0 else self.shown[i + 1] & self.shown[i + 2]
            one, two = np.sqrt(self.gap[first]), np.sqrt(self.gap[second])
            big, small = np.maximum(one, two), np.minimum(one, two)
            return seen & (big <= t.jump_ratio * small) & (big - small <= t.jump)

        before, after = self.gap[i - 1], self.gap[i]
        bent = cosine[i] > t.bent
        cases = [
            ((codes[0] == ACROSS) & (codes[1] == AWAY) & (after > t.gap) & (after > t.gap_ratio * before), bent & smooth(0)),
            ((codes[0] == AWAY) & (codes[1] == ACROSS) & (before > t.gap) & (before > t.gap_ratio * after), bent & smooth(1)),
            ((codes[0] == ACROSS) & (codes[1] == FAR), smooth(0)),
            ((codes[0] == FAR) & (codes[1] == ACROSS), smooth(1)),
        ]
        left = np.ones(len(i), bool)
        for case, sure in cases:
            self.label[i[left & case & sure]] = EDGE_JUMP
            left &= ~case
        self.label[i[left & (codes[0] > ACROSS) & (codes[1] > ACROSS) & (self.label[i] == NONE)]] = WIRE
        return cosine

    def small_planes(self, head: int, cosine: np.ndarray) -> None:
        i = np.arange(head + 1, self.n - 1)
        if not len(i):
            return
        big, small = np.maximum(self.gap[i - 1], self.gap[i]), np.minimum(self.gap[i - 1], self.gap[i])
        near = self.shown[i] & self.shown[i - 1] & self.shown[i + 1] & (small >= 1e-8) & (cosine[i] < self.at.flat) & (big < self.at.flat_ratio * small)
        for k in i[near].tolist():
            if self.label[k] == NONE:
                own = self.label[k - 1 : k + 2]
                own[own == NONE] = PLANE

    def labelled(self) -> np.ndarray:
        head = int(np.argmax(self.shown))
        self.planes(head)
        self.small_planes(head, self.edges(head))
        return self.label


def label_ring_features(points: DataFrame, livox: bool = False, limits: Limits = Limits()) -> DataFrame:
    """points (scan_id, ring, seq, x, y, z) with label. Rings are independent; a plane's search skips along its ring, so a ring is one group.

    Rings of five points or fewer, and those wholly inside the blind range, have no rows.
    """

    def label(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("seq", kind="stable")
        ring = Ring(df[["x", "y", "z"]].to_numpy(), livox, limits)
        if ring.n <= 5 or not ring.shown.any():
            return df.head(0).assign(label=pd.Series(dtype="int32"))
        return df.assign(label=ring.labelled().astype("int32"))

    rows = points.select("scan_id", F.col("ring").cast("int").alias("ring"), "seq", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    return rows.groupBy("scan_id", "ring").applyInPandas(label, "scan_id long, ring int, seq long, x double, y double, z double, label int")
