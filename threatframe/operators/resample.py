"""Exact k nearest neighbours and SMOTE oversampling.

kNN by tiles: points in (cell of the nearest reference point, distance to it) order are
cut into tiles of bounded size, so near points share a tile.  Pass 1 takes each tile by
itself and bounds every point's k-th neighbour distance.  Pass 2 takes the pairs of tiles
that the triangle inequality, by the tiles' distances to every reference point, does not
tell to be too far apart; inside a pair the same test leaves out blocks of columns.

Distances of a block come from one matrix product.  What may lie within a point's bound,
rounding allowed for, is measured again as a plain sum of squares, so the result is exact
for any data.  Of equal vectors in a tile only the k + 1 smallest ids are compared with
others.  A task holds two tiles and gives k rows per point at most; on data without any
structure in its distances every pair of points passes through a product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from threatframe.functions.scalars import hash_fraction
from threatframe.operators.joins import cap_per_group
from threatframe.operators.rank import global_rank
from threatframe.session import cut_lineage


#: Most reference points.
REFERENCES = 256
#: Fewest and most points of a tile, and most bytes of its vectors.
TILE, TILE_BYTES = (1024, 32768), 1 << 24
#: Points and columns of one matrix product.
ROWS, COLUMNS = 512, 2048


def _references(pts: DataFrame, n: int) -> np.ndarray:
    """About sqrt(n) points, the first in hash order; the driver holds REFERENCES at most."""
    size = int(min(REFERENCES, max(1, n ** 0.5)))
    rows = pts.orderBy(F.xxhash64("id"), "id").limit(size).select("v").collect()
    refs = np.array([r.v for r in rows], dtype=np.float64)
    finite = np.isfinite(refs).all(axis=1) if len(refs) else []
    return refs[finite] if np.any(finite) else np.zeros_like(refs[:1])


def _slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What squared distances by matrix product may be off by, per row of squared norms `a`."""
    top = b[np.isfinite(b)].max(initial=0.0)
    return 8 * 2.3e-16 * 64 * (a + top)


def _to_references(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances to all reference points, what each row's may be off by)"""
    with np.errstate(all="ignore"):
        a, b = (x * x).sum(axis=1), (refs * refs).sum(axis=1)
        d2 = a[:, None] + b - 2 * (x @ refs.T)
        return np.sqrt(np.maximum(d2, 0)), 2 * np.sqrt(_slack(a, b) * _dims(x))


def _dims(x: np.ndarray) -> float:
    return max(1.0, x.shape[1] / 64)


def _place(refs: np.ndarray):
    @F.pandas_udf("cell int, d double")
    def run(rows: pd.Series) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"cell": np.zeros(0, np.int32), "d": np.zeros(0)})
        ds, _off = _to_references(np.stack(rows.to_numpy()).astype(float), refs)
        ds = np.where(np.isnan(ds), np.inf, ds)
        return pd.DataFrame({"cell": ds.argmin(axis=1).astype(np.int32), "d": ds.min(axis=1)})
    return run


def _first_copies(y: np.ndarray, ranks: np.ndarray, k: int) -> np.ndarray:
    """Positions, ascending, of the k + 1 least ranks of each distinct row."""
    seen: dict[bytes, int] = {}
    keep = np.zeros(len(y), dtype=bool)
    for i in np.argsort(ranks, kind="stable"):
        key = y[i].tobytes()
        seen[key] = seen.get(key, 0) + 1
        keep[i] = seen[key] <= k + 1
    return np.flatnonzero(keep)


def _exact(xt: np.ndarray, yt: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (r, c), summed in the order of the components."""
    out = np.zeros(len(r))
    for a, b in zip(xt, yt):
        t = a[r] - b[c]
        out += t * t
    return out


def _nearest(x, xid, y, yid, refs, k: int, cut: np.ndarray):
    """(row, column, d2) of the k nearest columns `y` of each row `x` by (d2, id), of those
    whose d2 does not exceed the row's `cut`; a column with the row's own id is none."""
    ranks = np.unique(np.concatenate([xid, yid]), return_inverse=True)[1]
    xr, yr = ranks[:len(x)], ranks[len(x):]
    cols = _first_copies(y, yr, k)
    y, yr = y[cols], yr[cols]
    with np.errstate(all="ignore"):
        nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
        err = _slack(nx, ny) * _dims(x)
        (rx, ox), (ry, oy) = _to_references(x, refs), _to_references(y, refs)
        starts = range(0, len(y), COLUMNS)
        low = [(ry[s:s + COLUMNS] - oy[s:s + COLUMNS, None]).min(axis=0) for s in starts]
        high = [(ry[s:s + COLUMNS] + oy[s:s + COLUMNS, None]).max(axis=0) for s in starts]
        xt, yt, double = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), -2 * y.T
        cut = cut.copy()
        found = []
        for at in range(0, len(x), ROWS):
            rows = np.arange(at, min(at + ROWS, len(x)))
            best = (rows[:0], rows[:0], np.zeros(0))
            gap = np.stack([np.maximum(lo - rx[rows], rx[rows] - hi).max(axis=1) - ox[rows]
                            for lo, hi in zip(low, high)]) if len(low) else np.zeros((0, len(rows)))
            for j in np.argsort(gap.sum(axis=1), kind="stable"):
                s = j * COLUMNS
                live = rows[~(gap[j] > np.sqrt(cut[rows]) * (1 + 1e-9))]
                if not len(live):
                    continue
                d = x[live] @ double[:, s:s + COLUMNS]
                d += ny[s:s + COLUMNS]
                # the (k + 1)th, as the row itself may be a column
                loose = np.flatnonzero(~np.isfinite(cut[live]))
                if len(loose) and d.shape[1] > k:
                    kth = np.partition(d[loose], k, axis=1)[:, k] + nx[live[loose]] + 2 * err[live[loose]]
                    cut[live[loose]] = np.where(np.isnan(kth), np.inf, kth)
                i, c = np.nonzero(~(d > (cut[live] + err[live] - nx[live])[:, None]))
                r, c = live[i], c + s
                other = xr[r] != yr[c]
                r, c = r[other], c[other]
                if not len(r):
                    continue
                d2 = _exact(xt, yt, r, c)
                r, c, d2 = (np.concatenate(z) for z in zip(best, (r, c, d2)))
                order = np.lexsort((yr[c], d2, r))  # NaN comes last
                r, c, d2 = r[order], c[order], d2[order]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                last = (nth == k - 1) & ~np.isnan(d2)
                cut[r[last]] = np.minimum(cut[r[last]], d2[last])
                kept = (nth < k) & ~(d2 > cut[r])
                best = (r[kept], c[kept], d2[kept])
            found.append(best)
    r, c, d2 = (np.concatenate(z) for z in zip(*found))
    return r, cols[c], d2


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(float) + 0.0  # -0.0 and 0.0 are one value


def candidates(pts: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """Pairs (id, nn_id, d2) that hold the k nearest other points of every `pts` (id, v);
    a point has k of a tile at most.  `block` sets the size of a tile."""
    pts = pts.filter(F.col("id").isNotNull())
    kind = pts.schema["id"].dataType.simpleString()
    n = pts.count()
    refs = _references(pts, n)
    if not len(refs):
        return pts.sparkSession.createDataFrame([], f"id {kind}, nn_id {kind}, d2 double")
    most = min(TILE[1], max(64, TILE_BYTES // (8 * max(1, refs.shape[1]))))
    size = block or min(max(n // 8 + 1, TILE[0]), most)
    known = cut_lineage(pts.select("id", "v", _place(refs)("v").alias("at")).select("id", "v", "at.*"))
    tiled = global_rank(known, ["cell", "d", "id"], name="_r").select(
        "id", "v", F.floor((F.col("_r") - 1) / size).cast("long").alias("tile"))
    n_tiles = -(-n // size)

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(pdf["v"]), pdf["id"].to_numpy()
        r, c, d2 = _nearest(x, ids, x, ids, refs, k, np.full(len(x), np.inf))
        first = np.searchsorted(r, np.arange(len(x) + 1))
        cut = np.full(len(x), np.inf)
        full = np.flatnonzero(np.diff(first) == k)
        kth = d2[first[full] + k - 1]
        cut[full] = np.where(np.isnan(kth), np.inf, kth)
        with np.errstate(all="ignore"):
            ds, off = _to_references(x, refs)
            lo, hi = (ds - off[:, None]).min(axis=0), (ds + off[:, None]).max(axis=0)
            lo, hi = np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi)
        rest = [None] * (len(x) - 1)
        cuts = [slice(i, j) for i, j in zip(first, first[1:])]
        return pd.DataFrame({
            "id": ids, "v": pdf["v"], "tile": pdf["tile"], "cut": cut,
            "nn_id": [ids[c[s]] for s in cuts], "d2": [d2[s] for s in cuts],
            "lo": [lo, *rest], "hi": [hi, *rest], "reach": [float(np.sqrt(cut.max())), *rest]})

    # a given number of partitions: few bytes, much work
    first = cut_lineage(tiled.repartition(_tasks(pts, n_tiles), "tile").groupBy("tile").applyInPandas(
        own, f"id {kind}, v array<double>, tile long, cut double, nn_id array<{kind}>, "
             "d2 array<double>, lo array<double>, hi array<double>, reach double"))
    inside = first.select("id", F.explode(F.arrays_zip("nn_id", "d2")).alias("p")).select("id", "p.*")
    if n_tiles == 1:
        return inside

    tiles = first.filter("lo is not null").select("tile", "lo", "hi", "reach")
    a, b = (tiles.select(*[F.col(c).alias(f"{c}_{s}") for c in tiles.columns]) for s in "ab")
    reach = F.greatest("reach_a", "reach_b") * (1 + 1e-9)
    apart = [F.exists(F.zip_with(x, y, lambda p, q: p - q), lambda g: g > reach)
             for x, y in (("lo_b", "hi_a"), ("lo_a", "hi_b"))]
    pairs = cut_lineage(a.join(b, (F.col("tile_a") < F.col("tile_b")) & ~(apart[0] | apart[1]))
                        .select(F.col("tile_a").alias("a"), F.col("tile_b").alias("b")))
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("tile"))

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pdf[pdf["tile"] == pdf[s].iloc[0]] for s in ("a", "b")]
        (x, xid, xcut), (y, yid, ycut) = [
            (_matrix(p["v"]), p["id"].to_numpy(), p["cut"].to_numpy()) for p in parts]
        out = []
        for s, sid, scut, o, oid in ((x, xid, xcut, y, yid), (y, yid, ycut, x, xid)):
            r, c, d2 = _nearest(s, sid, o, oid, refs, k, scut)
            out.append(pd.DataFrame({"id": sid[r], "nn_id": oid[c], "d2": d2}))
        return pd.concat(out)

    spread = first.select("id", "v", "cut", "tile").join(sides, "tile") \
        .repartition(_tasks(pts, n_tiles * (n_tiles - 1) // 2), "a", "b")
    across = spread.groupBy("a", "b").applyInPandas(cross, f"id {kind}, nn_id {kind}, d2 double")
    return inside.unionByName(across)


def _tasks(df: DataFrame, groups: int) -> int:
    """Partitions for `groups` groups of equal size: several groups in each when many."""
    return int(min(2 * groups, max(2000, 4 * df.sparkSession.sparkContext.defaultParallelism)))


def knn(df: DataFrame, id_col: str, vec: str, k: int = 5, block: int | None = None) -> DataFrame:
    """(id, nn_id, nn_rank, dist) for the k nearest other points (ties by id).

    Rows without a vector are no points.  With k points or fewer, each has all others."""
    pts = df.filter(F.col(vec).isNotNull()).select(
        F.col(id_col).alias("id"), F.transform(vec, lambda v: v.cast("double")).alias("v"))
    # pandas has NaN for null: a distance that is no number comes last
    near = candidates(pts, k, block).withColumn("d2", F.coalesce("d2", F.lit(float("nan"))))
    best = cap_per_group(near, ["id"], [F.col("d2"), F.col("nn_id")], k)
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.col("d2"), F.col("nn_id"))  # ≤ k rows per id
    return best.select(F.col("id").alias(id_col), "nn_id",
                       F.row_number().over(w).alias("nn_rank"), F.sqrt("d2").alias("dist"))


def smote(df: DataFrame, id_col: str, vec: str, label: str, minority, n_majority: int | None = None,
          ratio: float = 0.3, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority points: n_new = floor(ratio · majority) − minority.

    Synthetic j takes base point (j mod m) in id order, neighbour number
    1 + floor(min(k, m - 1) · h1(j)) of that point, and u = h2(j) from seeded hashes:
    x = base + u · (nn − base).  Every base point emits its share through
    `explode(sequence)` — no driver loop, no sampling of rows."""
    minor = df.filter(F.col(label) == minority).select(id_col, vec)
    counts = df.agg(F.count_if(F.col(label) == minority).alias("m"),
                    F.count_if(F.col(label) != minority).alias("M")).first()
    m, big = int(counts["m"]), int(n_majority if n_majority is not None else counts["M"])
    n_new = int(ratio * big) - m
    if n_new < 0:
        raise ValueError("minority already exceeds the requested ratio")
    if n_new > 0 and m == 1:
        raise ValueError("a single minority row has no neighbour to interpolate with")
    if n_new == 0 or m == 0:
        return df.sparkSession.createDataFrame([], f"synth_id long, base_id long, nn_id long, u double, {vec} array<double>")
    k = min(k, m - 1)  # a smaller minority has fewer neighbours
    ranked = global_rank(minor, [F.col(id_col)], name="_i")  # 1..m
    reps = F.floor(F.lit(n_new) / m) + F.when((F.col("_i") - 1) < (n_new % m), 1).otherwise(0)
    gen = ranked.withColumn("_t", F.explode(F.sequence(F.lit(0), (reps - 1).cast("int")))) \
        .filter(reps > 0)
    gen = gen.withColumn("synth_id", (F.col("_t") * m + F.col("_i") - 1).cast("long"))
    gen = gen.withColumn("nn_rank", (F.floor(hash_fraction(f"{seed}:nn", F.col("synth_id")) * k) + 1)
                         .cast("int"))
    gen = gen.withColumn("u", hash_fraction(f"{seed}:u", F.col("synth_id")))
    nn = knn(minor, id_col, vec, k).select(F.col(id_col).alias("_base"), "nn_id", "nn_rank")
    vecs = minor.select(F.col(id_col).alias("nn_id"), F.col(vec).alias("_nv"))
    out = (gen.join(nn, (F.col(id_col) == F.col("_base")) & (gen["nn_rank"] == nn["nn_rank"]))
           .join(vecs, "nn_id"))
    point = F.zip_with(vec, "_nv", lambda a, b: a.cast("double")
                       + F.col("u") * (b.cast("double") - a.cast("double")))
    return out.select("synth_id", F.col(id_col).alias("base_id"), "nn_id", "u",
                      point.alias(vec))
