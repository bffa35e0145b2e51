"""One ranking from several differently-scaled scores.

Method: every score becomes its standing, the share of rows with a lower value, so that no scale or tail matters. The
correlation matrix of the standings is computed in one distributed pass, its first principal component gives the
loadings, and each loading's sign is turned to the declared direction of its score, so that a score which runs against
the others still counts the way it was declared. Rows are sorted by projection. With `weights="equal"` the oriented
loadings all take one size, so that each score counts alike: the projection is then the mean of the oriented standings.

Ranks are computed without gathering rows: distinct values are range-partitioned, and a partition needs only the row
counts of the partitions before it.

Defined cases: null and NaN are the lowest value and tie with each other; ties share a standing; equal projections are
ordered by the smaller id; a constant score has loading 0, and its declared direction with equal weights; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_total
from ..session import materialize


def standings(df: DataFrame, id_col: str, scores: Sequence[str]) -> DataFrame:
    """(id, one column `<score>_standing` per score): the share of rows with a lower value."""
    n = df.count()
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("v")) for k, c in enumerate(scores)])).alias("s"))
    long = materialize(long.select("id", F.col("s.k").alias("k"), F.col("s.v").alias("v")), "scores-long")
    values = long.groupBy("k", "v").agg(F.count("*").alias("n"))
    lower = running_total(values, [F.col("v").asc_nulls_first()], "n", "lower", group="k")
    ranked = long.alias("l").join(lower.alias("r"), (F.col("l.k") == F.col("r.k")) & F.col("l.v").eqNullSafe(F.col("r.v")))
    share = F.col("r.lower") / F.lit(max(n, 1))
    return ranked.groupBy(F.col("l.id").alias("id")).agg(*[F.max(F.when(F.col("l.k") == k, share)).alias(f"{c}_standing") for k, c in enumerate(scores)])


def loadings(df: DataFrame, columns: Sequence[str], directions: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, standard deviations, loadings of the first principal component of the correlation matrix, each turned to its direction; as they were).

    The component as a whole is first turned to agree with the directions; a loading that then still points against its
    direction is turned alone.
    """
    aggs = [F.avg(c) for c in columns] + [F.stddev_pop(c) for c in columns] + [F.covar_pop(a, b) for a, b in combinations(columns, 2)]
    row = [0.0 if x is None or x != x else float(x) for x in df.agg(*aggs).first()]
    k = len(columns)
    mean, std, rest = np.array(row[:k]), np.array(row[k : 2 * k]), row[2 * k :]
    matrix = np.eye(k)
    for (i, j), r in zip(combinations(range(k), 2), rest):
        matrix[i, j] = matrix[j, i] = r / (std[i] * std[j]) if std[i] > 0 and std[j] > 0 else 0.0
    matrix[std == 0] = matrix[:, std == 0] = 0
    vector = np.linalg.eigh(matrix)[1][:, -1]
    declared = np.sign(np.array(directions, dtype=float))
    vector = vector * (np.sign(vector @ declared) or 1.0)
    return mean, std, np.abs(vector) * declared, vector


def combined_ranking(df: DataFrame, id_col: str, scores: Sequence[str], directions: Sequence[int] | None = None, weights: str = "pc1") -> DataFrame:
    """(id, standings, projection, place): place 1 is the row with the highest projection."""
    directions = list(directions or [1] * len(scores))
    table = materialize(standings(df, id_col, scores), "standings")
    cols = [f"{c}_standing" for c in scores]
    mean, std, load, _ = loadings(table, cols, directions)
    if weights == "equal":
        # loadings of one size; summed in the order of the scores
        signs = [np.sign(w) or np.sign(s) for w, s in zip(load, directions)]
        total = sum((F.col(c) if s > 0 else 1 - F.col(c) for c, s in zip(cols, signs)), F.lit(0.0))
        projection = total / F.lit(float(len(cols)))
    else:
        projection = sum((F.lit(float(w / s)) * (F.col(c) - F.lit(float(m))) for c, m, s, w in zip(cols, mean, std, load) if s > 0), F.lit(0.0))
    scored = table.withColumn("projection", projection).withColumn("one", F.lit(1))
    placed = running_total(scored, [F.col("projection").desc(), F.col("id").asc()], "one", "before")
    return placed.withColumn("place", (F.col("before") + 1).cast("long")).drop("before", "one")


def weighting_report(df: DataFrame, id_col: str, scores: Sequence[str], directions: Sequence[int] | None = None) -> DataFrame:
    """(score, direction, loading, turned, rank_correlation, top_overlap): the component's loadings as they were and whether one had to be turned,
    and how both weightings compare: the correlation of their places and the share of the first 2 % they have in common."""
    directions = list(directions or [1] * len(scores))
    spark = df.sparkSession
    both = [combined_ranking(df, id_col, scores, directions, w).select("id", F.col("place").alias(w)) for w in ("equal", "pc1")]
    joined = materialize(both[0].join(both[1], "id"), "both-places")
    n = joined.count()
    top = (2 * n + 99) // 100
    r = joined.agg(F.corr("equal", "pc1").alias("r"), F.count_if((F.col("equal") <= top) & (F.col("pc1") <= top)).alias("c")).first()
    _, _, _, raw = loadings(standings(df, id_col, scores), [f"{c}_standing" for c in scores], directions)
    rows = [(c, int(s), float(w), bool(w * s < 0), float(r["r"] or 0.0), r["c"] / top if top else 0.0) for c, s, w in zip(scores, directions, raw)]
    return spark.createDataFrame(rows, "score string, direction int, loading double, turned boolean, rank_correlation double, top_overlap double")
