"""Components of images that are larger than a task: runs and labels tile by tile, links over the seams, union over all tiles.

A tile names its components by their first pixel; pixels on either side of a seam that touch link two names; names are united by rounds of
joins. No task holds more than one tile, no group more than a seam's neighbours, however large a component is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneatlas.operators import contours
from laneatlas.session import checkpointed, ship

#: A name holds the row in its upper half and the column in its lower one.
_HALF = 32


def tile_runs(mask: DataFrame, key: str, tile: int = 256) -> DataFrame:
    """mask (key, r, c of set pixels) to its runs within tiles: key, r, a, b (first and last column) and name, that of the run's component in the tile."""
    ship(mask.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["_y"].iloc[0]) * tile, int(pdf["_x"].iloc[0]) * tile
        image = np.zeros((tile, tile), bool)
        image[pdf["r"].to_numpy() - top, pdf["c"].to_numpy() - left] = True
        label = contours.components(image)
        row, first, last = contours._runs(image)
        own = label[row, first]
        _, at = np.unique(own, return_index=True)  # runs come in reading order, so the first of a label holds its first pixel
        names = (row[at].astype(np.int64) + top << _HALF) + first[at] + left
        return pd.DataFrame({key: pdf[key].iloc[0], "r": row + top, "a": first + left, "b": last + left, "name": names[own - 1]})

    dealt = mask.select(key, "r", "c", F.floor(F.col("r") / tile).alias("_y"), F.floor(F.col("c") / tile).alias("_x"))
    return dealt.groupBy(key, "_y", "_x").applyInPandas(run, f"{key} {dict(mask.dtypes)[key]}, r int, a int, b int, name long")


def seam_links(runs: DataFrame, key: str, tile: int = 256) -> DataFrame:
    """key, u, v (u < v): names of components that touch over a seam, by a corner too. Only pixels beside seams are joined."""
    spread = F.explode(F.sequence("a", "b")).alias("c")
    # the last row of a tile against the row below it, and the last column of a tile against the next one; corners come with the first
    below = runs.where(F.col("r") % tile == tile - 1).select(key, (F.col("r") + 1).alias("r"), F.col("name").alias("u"), spread)
    below = below.select(key, "r", "u", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"))
    upper = runs.where(F.col("r") % tile == 0).select(key, "r", spread, F.col("name").alias("v"))
    right = runs.where(F.col("b") % tile == tile - 1).select(key, F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1)).alias("r"), F.col("name").alias("u"), (F.col("b") + 1).alias("c"))
    left = runs.where(F.col("a") % tile == 0).select(key, "r", F.col("a").alias("c"), F.col("name").alias("v"))
    both = below.join(upper, [key, "r", "c"]).select(key, "u", "v").unionByName(right.join(left, [key, "r", "c"]).select(key, "u", "v"))
    return both.where("u <> v").select(key, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def united(links: DataFrame, key: str, rounds: int = 100) -> DataFrame:
    """key, name, root: the smallest name that links reach, for names that links have (but the smallest ones).

    Alternately each name hands its larger neighbours to its smallest one, and its smaller ones; what remains is a star about each root. Each round is checkpointed
    to the shared folder. RuntimeError after `rounds`, with no partial result."""

    def least(edges: DataFrame) -> DataFrame:
        """u, v of edges with m, the least of u and its neighbours v."""
        return edges.join(edges.groupBy(key, "u").agg(F.least(F.col("u"), F.min("v")).alias("m")), [key, "u"])

    edges = checkpointed(links.select(key, "u", "v"))
    size = None
    for _ in range(rounds):
        ways = edges.unionByName(edges.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(ways).where("v > u and v <> m").select(key, F.col("m").alias("u"), "v").distinct()
        down = large.select(key, F.col("v").alias("u"), F.col("u").alias("v"))  # u larger
        near = least(down)
        edges = checkpointed(near.where("v <> m").select(key, F.col("m").alias("u"), "v").unionByName(near.select(key, F.col("m").alias("u"), F.col("u").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash(key, "u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == size:
            return edges.select(key, F.col("v").alias("name"), F.col("u").alias("root"))
        size = tuple(now)
    raise RuntimeError(f"components not united in {rounds} rounds")


def tiled_components(mask: DataFrame, key: str, tile: int = 256) -> DataFrame:
    """One row a component: key, root (its name), n_pixels, x, y, w, h. The same for every size of tiles."""
    runs = checkpointed(tile_runs(mask, key, tile))
    roots = united(seam_links(runs, key, tile), key)
    named = runs.groupBy(key, "name").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n"), F.min("a").alias("x"), F.max("b").alias("xx"), F.min("r").alias("y"), F.max("r").alias("yy"))
    whole = named.join(roots, [key, "name"], "left").groupBy(key, F.coalesce("root", "name").alias("root"))
    out = whole.agg(F.sum("n").alias("n_pixels"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("xx") - F.min("x") + 1).alias("w"), (F.max("yy") - F.min("y") + 1).alias("h"))
    return out.select(key, "root", "n_pixels", "x", "y", "w", "h")


def tiled_labels(mask: DataFrame, key: str, tile: int = 256) -> DataFrame:
    """key, r, a, b, root: runs of pixels with the component they belong to."""
    runs = checkpointed(tile_runs(mask, key, tile))
    roots = united(seam_links(runs, key, tile), key)
    return runs.join(roots, [key, "name"], "left").select(key, "r", "a", "b", F.coalesce("root", "name").alias("root"))
