"""Naming of unknown vectors by conformal tests against the calibration vectors of known families."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Calibration vectors of a family at most, so that all of them may be sent to every task.
CALIBRATION = 100


class Family:
    """Calibration scores of one family: distances to near members, and overlap of the largest coordinates."""

    def __init__(self, x: np.ndarray, near: int, top: int):
        self.x, self.near, self.top = x, near, top
        self.distances = np.sort(self._to(x), axis=1)[:, 1 : near + 1].mean(axis=1)  # the first is the vector itself
        self.usual = self.support(x.mean(axis=0)[None])[0]
        self.overlaps = self.overlap(x)

    def _to(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[:, None] - self.x[None]) ** 2).sum(axis=2))

    def support(self, x: np.ndarray) -> np.ndarray:
        """Whether each coordinate is among the largest ``top``."""
        out = np.zeros(x.shape, bool)
        np.put_along_axis(out, np.argsort(-x, axis=1, kind="stable")[:, : self.top], True, axis=1)
        return out

    def overlap(self, x: np.ndarray) -> np.ndarray:
        own = self.support(x)
        return (own & self.usual).sum(axis=1) / (own | self.usual).sum(axis=1)

    def p_near(self, x: np.ndarray) -> np.ndarray:
        scores = np.sort(self._to(x), axis=1)[:, : self.near].mean(axis=1)
        return (1 + (self.distances[None] >= scores[:, None]).sum(axis=1)) / (len(self.x) + 1)

    def p_alike(self, x: np.ndarray) -> np.ndarray:
        return (1 + (self.overlaps[None] <= self.overlap(x)[:, None]).sum(axis=1)) / (len(self.x) + 1)


def calibration(vectors: DataFrame, family: str, order: str, most: int = CALIBRATION) -> DataFrame:
    """The first ``most`` vectors of each family."""
    place = F.row_number().over(Window.partitionBy(family).orderBy(order))
    return vectors.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def conformal_knn(probes: DataFrame, known: DataFrame, key: str, family: str, vector: str, near: int = 5, top: int = 4, alpha: float = 0.1) -> DataFrame:
    """(key, decision) of each probe: ``name:<family>`` if one family accepts it, ``ambiguous`` if several do.

    A probe that none accepts by distance is tested by its largest coordinates: ``variant:<family>``, ``ambiguous``,
    or ``unfamiliar`` if that fails too.  ``known`` is a bounded calibration table (see `calibration`).
    """
    rows = known.select(family, vector).collect()
    names = sorted({r[0] for r in rows})
    shared = probes.sparkSession.sparkContext.broadcast([np.array([r[1] for r in rows if r[0] == n], float) for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        families = [Family(x, near, top) for x in shared.value]
        for batch in batches:
            out = []
            for at in range(0, len(batch), 256):
                x = np.array(batch[vector].iloc[at : at + 256].tolist(), float)
                accepted = np.array([f.p_near(x) > alpha for f in families]).T
                alike = np.array([f.p_alike(x) > alpha for f in families]).T
                for by_distance, by_support in zip(accepted, alike, strict=True):
                    kind, which = ("name", by_distance) if by_distance.any() else ("variant", by_support)
                    out.append("unfamiliar" if not which.any() else "ambiguous" if which.sum() > 1 else f"{kind}:{names[int(which.argmax())]}")
            yield pd.DataFrame({key: batch[key], "decision": out})

    return probes.select(key, vector).mapInPandas(run, f"{key} {probes.schema[key].dataType.simpleString()}, decision string")
