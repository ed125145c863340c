"""Cards that look alike, and places in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def distinct_cards(cards: DataFrame, key: str, near_m: float = 200.0) -> DataFrame:
    """Keeps, in order of pos, each card unless one kept before has the same minutes and fare and both ends within near_m.

    cards(key, pos, minutes, fare, x0, y0, x1, y1) with metres of one projection; a key's cards are one answer's.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        ends = pdf[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float)
        alike = pdf.groupby(["minutes", "fare"], sort=False, dropna=False).ngroup().to_numpy()
        kept = np.zeros(len(pdf), dtype=bool)
        for i in range(len(pdf)):
            far = (ends[kept & (alike == alike[i])] - ends[i]) ** 2
            kept[i] = not ((far[:, 0] + far[:, 1] < near_m**2) & (far[:, 2] + far[:, 3] < near_m**2)).any()
        return pdf[kept]

    return cards.groupBy(key).applyInPandas(keep, cards.schema)


def assign_in_order(options: DataFrame, key: str, slack: float = 50.0) -> DataFrame:
    """For each key one option of each stop at most, so that along rises with the stops, give or take slack, and score is largest.

    options(key, stop, along, score). A key is one step of a journey. Each option looks up, among those of earlier
    stops whose along is at most slack more than its own, the chain of the largest score: these are kept by along,
    with the running maximum of their scores, and a stop's options enter together once all of them are scored.
    """

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["stop", "along"], ignore_index=True)
        along, score = pdf["along"].to_numpy(dtype=float), pdf["score"].to_numpy(dtype=float)
        chain, link = score.copy(), np.full(len(pdf), -1)
        known = np.zeros(0, dtype=int)  # options of the stops so far, by along
        for _, group in pdf.groupby("stop", sort=True).groups.items():
            mine = np.asarray(group)
            if len(known):
                upto = np.searchsorted(along[known], along[mine] + slack, side="right")
                running = np.maximum.accumulate(chain[known])
                leader = known[np.maximum.accumulate(np.where(chain[known] == running, np.arange(len(known)), 0))]
                reached = np.maximum(upto - 1, 0)
                gains = (upto > 0) & (running[reached] > 0)
                chain[mine[gains]] += running[reached[gains]]
                link[mine[gains]] = leader[reached[gains]]
            known = np.concatenate([known, mine])
            known = known[np.argsort(along[known], kind="stable")]
        if not len(pdf):
            return pdf
        taken, last = [], int(chain.argmax())
        while last >= 0:
            taken.append(last)
            last = int(link[last])
        return pdf.iloc[taken[::-1]]

    return options.groupBy(key).applyInPandas(best, options.schema)


def passes(points: DataFrame, path: DataFrame, corridor_m: float, distance) -> DataFrame:
    """Each pass of a path by a point: the runs of segments within the corridor, with their nearest segment.

    path(path_id, seg, ...) meets points(path_id, point_id, ...); distance: metres as an expression of both.
    """
    near = points.join(path, "path_id").withColumn("d", distance).filter(F.col("d") <= corridor_m)
    w = Window.partitionBy("path_id", "point_id").orderBy("seg")
    island = near.withColumn("island", F.col("seg") - F.row_number().over(w))
    return island.groupBy("path_id", "point_id", "island").agg(F.min(F.struct("d", "seg")).alias("b"), F.min("seg").alias("first_seg"), F.max("seg").alias("last_seg")).select("path_id", "point_id", "first_seg", "last_seg", F.col("b.seg").alias("seg"), F.col("b.d").alias("d"))

