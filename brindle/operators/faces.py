"""Face vectors to named piles, and greedy groups of what is left."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import vectors as V

ASSIGN, SUGGEST = 0.62, 0.45
#: Piles that may be sent to every task.
MOST_PILES = 10_000


def assign(faces: DataFrame, piles: DataFrame) -> DataFrame:
    """(face, pile, sim, outcome): the nearest pile of each face, assigned, suggested or open.

    faces: (face, v); piles: (pile, c), at most MOST_PILES of them, which is checked before they are
    broadcast. No row is kept for each pair: a face keeps its best pile as it goes.
    """
    if piles.limit(MOST_PILES + 1).count() > MOST_PILES:
        raise ValueError(f"more than {MOST_PILES} piles; index them")
    table = F.broadcast(piles.agg(F.collect_list(F.struct("pile", "c")).alias("all")))
    best = F.array_max(F.transform("all", lambda p: F.struct(F.round(V.cosine(F.col("v"), p["c"]), 6).alias("sim"), (-p["pile"]).alias("neg"))))
    met = faces.join(table).withColumn("b", best)
    outcome = F.when(F.col("sim") >= ASSIGN, "assigned").when(F.col("sim") >= SUGGEST, "suggested").otherwise("open")
    return met.select("face", (-F.col("b.neg")).alias("pile"), F.col("b.sim").alias("sim")).withColumn("outcome", outcome)


def greedy(faces: DataFrame, block: str = "block") -> DataFrame:
    """(face, grp) of (face, v, block): in order of id, a face joins the first group of its block whose
    running mean is near enough, or starts one. Order decides, so a block is one task's work: keep blocks small."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("face")
        means: list[np.ndarray] = []
        sizes: list[int] = []
        names: list[int] = []
        out = []
        for face, v in zip(rows["face"], rows["v"], strict=True):
            x = np.array(v, float)
            x = x / (np.linalg.norm(x) or 1)
            sims = np.array([m @ x / (np.linalg.norm(m) or 1) for m in means])
            near = np.flatnonzero(sims >= ASSIGN)
            if len(near):
                k = int(near[0])
                means[k] = (means[k] * sizes[k] + x) / (sizes[k] + 1)
                sizes[k] += 1
            else:
                k = len(means)
                means.append(x)
                sizes.append(1)
                names.append(int(face))
            out.append(names[k])
        return pd.DataFrame({"face": rows["face"], "grp": out})

    return faces.groupBy(block).applyInPandas(work, "face long, grp long")
