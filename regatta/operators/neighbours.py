"""Mutual information from nearest neighbours (Kraskov, Stoegbauer and Grassberger 2004).

Per feature and row the estimator needs the distance to the third neighbour in the plane of
(feature, target), and how many rows lie closer than that on each axis alone. Both are exact
here and both are spread out:

* The plane is cut into cells of about ``CELL_ROWS`` rows by a k-d tree learnt from a sample
  (the sample only decides where rows are processed). A row whose neighbourhood stays inside
  its cell is finished there; the others also ask the cells their neighbourhood touches, of
  which only the rows within reach of a border are sent.
* On an axis, rows are dealt by value ranges. A row whose interval lies in its range is counted
  there; for the others a count is the difference of two ranks, each the size of the ranges
  before plus a rank inside one.

A tiny jitter, part of the estimator, separates equal values, so a value shared by a third of
the rows is still cut into cells. It is a function of the row's key, and the score therefore the
same on any layout.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.columns import col, require_columns
from regatta.functions.hashing import MODULUS, add_key_hash
from regatta.session import materialize

NEIGHBOURS = 3
JITTER = 1e-10
CELL_ROWS = 50_000
SAMPLE_PER_CELL = 50
MAX_CELLS = 1 << 18  # what the tree sent to every task may hold; with more rows, cells grow
AXIS_CELLS = 16
"""Cells' worth of rows in a value range of an axis."""
BLOCK = 12
"""Points of a block of nearby ones, at least; there are less than twice as many."""
BLOCKS, QUERIES = 1 << 12, 1 << 12
"""Blocks, and queries, that are looked at together."""


def mutual_info_neighbours(
    df: DataFrame,
    features: list[str],
    target: str,
    neighbours: int = NEIGHBOURS,
    jitter: float = JITTER,
    cell_rows: int = CELL_ROWS,
    seed: int = 0,
    n_jobs: int = 2,
    key_cols: list[str] = (),
) -> DataFrame:
    """``feature, ordinal, score`` in nats, never below 0.

    Without key columns a row is known by its whole content, and equal rows by their number.
    """
    require_columns(df, [*features, target])

    rows, keys = _keyed(df, features, target, list(key_cols))

    def score(at: int) -> tuple:
        plane, n = _plane(df, rows, keys, at, features[at], target, jitter, seed + at)
        if n <= neighbours:
            raise ValueError(f"{n} rows are too few for {neighbours} neighbours")
        return features[at], at, _information(plane, n, neighbours, cell_rows)

    with ThreadPoolExecutor(max_workers=max(1, n_jobs)) as pool:
        scores = list(pool.map(score, range(len(features))))
    return df.sparkSession.createDataFrame(scores, "feature string, ordinal int, score double")


COPIES = 1_000_000
"""Equal rows that are numbered at a time."""


def _keyed(df: DataFrame, features: list[str], target: str, key_cols: list[str]) -> tuple[DataFrame, list[str]]:
    """``x0, x1 ... y``, and the columns that tell rows apart: without keys numbered, written once."""
    xs = [col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    y = col(target).cast("double").alias("y")
    if key_cols:
        keys = [col(k).alias(f"k{i}") for i, k in enumerate(key_cols)]
        return df.select(*xs, y, *keys), [f"k{i}" for i in range(len(keys))]
    content = F.xxhash64(*[col(n) for n in df.columns]).alias("k")
    present = df.where(col(target).cast("double").isNotNull()).select(*xs, y, content)
    alike = present.groupBy(*present.columns).count()
    lots = alike.withColumn("lot", F.explode(F.sequence(F.lit(0), F.expr(f"(count - 1) div {COPIES}"))))
    size = F.least(F.lit(COPIES), F.expr(f"count - lot * {COPIES}")).cast("int")
    numbered = lots.withColumn("i", F.explode(F.sequence(F.lit(1), size)))
    copy = (F.col("lot") * COPIES + F.col("i")).alias("copy")
    return materialize(numbered.select(*present.columns, copy)), ["k", "copy"]


def _plane(
    df: DataFrame, rows: DataFrame, keys: list[str], at: int, feature: str, target: str, jitter: float, seed: int
):
    """``id, x, y`` scaled to unit deviation and jittered, written once; and the row count."""
    x, y = col(feature).cast("double"), col(target).cast("double")
    both = df.where(x.isNotNull() & y.isNotNull()).select(x.alias("x"), y.alias("y"))
    s = both.agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate(
            (F.stddev_pop, lambda v: F.avg(F.abs(v))))],
    ).first()
    own = F.col(f"x{at}")
    pair = rows.where(own.isNotNull() & F.col("y").isNotNull()).select(own.alias("x"), "y", *keys)
    for i in range(4 if jitter else 0):
        pair = add_key_hash(pair, keys, f"__h{i}", 4 * seed + i)

    def moved(c: str, salt: int) -> Column:
        deviation = s[f"{c}0"] or 1.0
        size = max(1.0, (s[f"{c}1"] or 0.0) / deviation)
        out = F.col(c) / F.lit(deviation)
        if jitter:  # a normal number from two even ones (Box and Muller 1958)
            one, two = ((F.col(f"__h{2 * salt + i}") + 0.5) / F.lit(float(MODULUS)) for i in (0, 1))
            out = out + F.sqrt(-2.0 * F.ln(one)) * F.cos(F.lit(2 * math.pi) * two) * F.lit(jitter * size)
        return out.alias(c)

    numbered = pair.select(F.monotonically_increasing_id().alias("id"), moved("x", 0), moved("y", 1))
    return materialize(numbered), s["n"]


def _information(rows: DataFrame, n: int, k: int, cell_rows: int) -> float:
    wanted = min(MAX_CELLS, -(-n // cell_rows))
    sample = np.zeros((1, 2))
    if wanted > 1:
        share = min(1.0, wanted * SAMPLE_PER_CELL / n)
        drawn = rows.sample(share, seed=1).select("x", "y").toPandas().to_numpy()
        sample = drawn if len(drawn) else sample
    radii = _radii(rows, k, plan_cells(sample, wanted))
    parts = -(-n // (cell_rows * AXIS_CELLS))
    means = [_sum_digamma(radii, axis, axis_edges(v, parts)) / n for axis, v in zip("xy", sample.T, strict=True)]
    return max(0.0, float(digamma_at(n) + digamma_at(k) - sum(means)))


def digamma_at(n: int) -> float:
    return float(-np.euler_gamma + sum(1.0 / i for i in range(1, n))) if n < 64 else float(
        np.log(n) - 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4)
    )


def digamma(n: Column | np.ndarray, log=F.ln) -> Column | np.ndarray:
    """Digamma of a positive whole number: shifted up by 8, then the asymptotic series."""
    m = n + 8.0
    square = m * m
    series = log(m) - 1 / (2 * m) - 1 / (12 * square) + 1 / (120 * square * square)
    for j in range(8):
        series = series - 1 / (n + float(j))
    return series - 1 / (252 * square * square * square)


# -- the plane -----------------------------------------------------------------------


@dataclass
class _Cells:
    """A k-d tree: inner nodes hold an axis and a cut, leaves the number of a cell."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray
    boxes: np.ndarray  # cell x (x low, x high, y low, y high)

    def locate(self, xy: np.ndarray) -> np.ndarray:
        at = np.zeros(len(xy), dtype=np.int64)
        rows = np.arange(len(xy))
        while (inner := self.axis[at] >= 0).any():
            below = xy[rows, np.maximum(self.axis[at], 0)] < self.cut[at]
            at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
        return self.cell[at]

    def touched(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, cell)`` pairs of boxes that reach into cells."""
        query, node = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        done_q, done_c = [], []
        while len(query):
            leaf = self.axis[node] < 0
            done_q.append(query[leaf])
            done_c.append(self.cell[node[leaf]])
            query, node = query[~leaf], node[~leaf]
            axis, cut = self.axis[node], self.cut[node]
            goes_left, goes_right = low[query, axis] < cut, high[query, axis] >= cut
            query, node = (
                np.concatenate([query[goes_left], query[goes_right]]),
                np.concatenate([self.left[node[goes_left]], self.right[node[goes_right]]]),
            )
        return np.concatenate(done_q), np.concatenate(done_c)


def plan_cells(sample: np.ndarray, cells: int) -> _Cells:
    axis, cut, left, right, cell, boxes = [], [], [], [], [], []

    def grow(points: np.ndarray, wanted: int, box: list) -> int:
        me = len(axis)
        for values, v in ((axis, -1), (cut, 0.0), (left, 0), (right, 0), (cell, -1)):
            values.append(v)
        spread = points.max(0) - points.min(0) if len(points) > 3 else np.zeros(2)
        if wanted <= 1 or spread.max() <= 0:
            cell[me] = len(boxes)
            boxes.append(box)
            return me
        a = int(spread.argmax())
        c = float(np.median(points[:, a]))
        below = points[:, a] < c
        if not below.any():
            cell[me] = len(boxes)
            boxes.append(box)
            return me
        axis[me], cut[me] = a, c
        lower, upper = list(box), list(box)
        lower[2 * a + 1] = upper[2 * a] = c
        left[me] = grow(points[below], wanted // 2, lower)
        right[me] = grow(points[~below], wanted - wanted // 2, upper)
        return me

    grow(sample, cells, [-np.inf, np.inf, -np.inf, np.inf])
    return _Cells(*map(np.array, (axis, cut, left, right, cell)), np.array(boxes))


@dataclass
class _Blocks:
    """Points halved again and again along the longer side, into blocks of equal size.

    ``places`` has a row of point numbers for each block; those from ``len(x) - 1`` on, infinitely
    far away, fill blocks up. ``boxes`` has what encloses each node, for each halving.
    """

    x: np.ndarray
    y: np.ndarray
    places: np.ndarray
    boxes: list[tuple[np.ndarray, ...]]

    def near(self, x: np.ndarray, y: np.ndarray, reach: np.ndarray, best: np.ndarray):
        """``(query, block, gap)`` where a gap between both leaves room up to reach and below the best."""
        query, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level, (x0, x1, y0, y1) in enumerate(self.boxes):
            if level:
                query, node = np.repeat(query, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
            qx, qy = x[query], y[query]
            gap = np.maximum(np.maximum(x0[node] - qx, qx - x1[node]), np.maximum(y0[node] - qy, qy - y1[node]))
            gap = np.maximum(gap, 0.0)
            hit = (gap <= reach[query]) & (gap < best[query])
            query, node = query[hit], node[hit]
        return query, node, gap[hit]


def blocks_of(x: np.ndarray, y: np.ndarray, least: int = BLOCK) -> _Blocks:
    n, levels = len(x), max(0, (len(x) // least).bit_length() - 1)
    size = -(-n // (1 << levels))
    px, py = np.append(x, np.inf), np.append(y, np.inf)
    places = np.minimum(np.arange(size << levels), n)
    for level in range(levels):
        places = places.reshape(1 << level, -1)
        vx, vy = px[places], py[places]
        wide = np.ptp(vx, axis=1) >= np.ptp(vy, axis=1)
        order = np.argpartition(np.where(wide[:, None], vx, vy), places.shape[1] // 2, axis=1)
        places = np.take_along_axis(places, order, axis=1)
    places = places.reshape(1 << levels, size)
    filled = places == n
    box = tuple(
        found for p in (px, py)
        for found in (p[places].min(axis=1), np.where(filled, -np.inf, p[places]).max(axis=1))
    )
    boxes = [box]
    for _ in range(levels):
        box = tuple((b[::2], b[1::2]) for b in box)
        box = tuple((np.minimum, np.maximum)[i % 2](*pair) for i, pair in enumerate(box))
        boxes.insert(0, box)
    return _Blocks(px, py, places, boxes)


def k_nearest(px, py, qx, qy, k: int, reach=None, same: bool = False) -> np.ndarray:
    """The k smallest Chebyshev distances per query, infinity where there are fewer.

    ``reach`` bounds what is worth finding. With ``same`` the queries are the points and a
    point is not its own neighbour; the bound then comes from its own block.
    """
    best = np.full((len(qx), k), np.inf)
    if not len(px):
        return best
    with np.errstate(invalid="ignore"):  # what fills blocks up is nowhere
        blocks = blocks_of(px, py, max(BLOCK, 2 * (k + 1)))
        own = np.full(len(qx), -1)
        if same:
            own = _within_blocks(blocks, k, best)
            reach = best[:, -1].copy()
        for a in range(0, len(qx), QUERIES):
            part = slice(a, a + QUERIES)
            query, block, gap = blocks.near(qx[part], qy[part], reach[part], best[part, -1])
            query += a
            other = block != own[query]
            query, block, gap = query[other], block[other], gap[other]
            order = np.lexsort((gap, query))
            query, block, gap = query[order], block[order], gap[order]
            while len(query):  # the nearest block of each query, and then what is still near enough
                first = np.concatenate([[True], query[1:] != query[:-1]])
                q, at = query[first], blocks.places[block[first]]
                d = np.maximum(np.abs(blocks.x[at] - qx[q, None]), np.abs(blocks.y[at] - qy[q, None]))
                d[d > reach[q, None]] = np.inf
                best[q] = np.sort(np.partition(np.concatenate([best[q], d], axis=1), k - 1, axis=1)[:, :k], axis=1)
                rest = ~first
                rest[rest] = gap[rest] < best[query[rest], -1]
                query, block, gap = query[rest], block[rest], gap[rest]
    return best


def _within_blocks(blocks: _Blocks, k: int, best: np.ndarray) -> np.ndarray:
    """Puts the k smallest distances to other points of the same block into ``best``; the blocks."""
    own, n = np.zeros(len(best) + 1, np.int64), len(best)
    size = blocks.places.shape[1]
    for a in range(0, len(blocks.places), BLOCKS):
        at = blocks.places[a:a + BLOCKS]
        x, y = blocks.x[at], blocks.y[at]
        d = np.maximum(np.abs(x[:, :, None] - x[:, None, :]), np.abs(y[:, :, None] - y[:, None, :]))
        d[:, np.arange(size), np.arange(size)] = np.inf
        if size > k:
            d = np.partition(d, k - 1, axis=2)[:, :, :k]
        d = np.sort(d, axis=2)
        there = at < n
        best[at[there], :d.shape[2]] = d[there]
        own[at] = np.arange(a, a + len(at))[:, None]
    return own[:n]


def _radii(rows: DataFrame, k: int, cells: _Cells) -> DataFrame:
    """``id, x, y, r``: the exact distance of every row to its k-th neighbour."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("bigint")
    def locate(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(shared.value.locate(np.column_stack([x, y])))

    def inside(key: tuple, table: pa.Table) -> pa.Table:
        cell, x, y = key[0].as_py(), table["x"].to_numpy(), table["y"].to_numpy()
        near = k_nearest(x, y, x, y, k, same=True)
        r = near[:, k - 1]
        x0, x1, y0, y1 = shared.value.boxes[cell]
        open_ = (x - r < x0) | (x + r >= x1) | (y - r < y0) | (y + r >= y1)
        ends = np.concatenate([[0], np.cumsum(open_ * k)]).astype(np.int32)
        return pa.table({
            "id": table["id"], "cell": np.full(len(x), cell), "x": x, "y": y, "r": r, "open": open_,
            "near": pa.ListArray.from_arrays(ends, near[open_].ravel()),
        })

    schema = "id bigint, cell bigint, x double, y double, r double, open boolean, near array<double>"
    placed = rows.withColumn("cell", locate("x", "y"))
    first = materialize(placed.groupBy("cell").applyInArrow(inside, schema))
    if len(cells.boxes) == 1:
        return first.select("id", "x", "y", "r")

    def asked(batches):
        for batch in batches:
            t = batch.to_pandas()
            xy, r = t[["x", "y"]].to_numpy(), t["r"].to_numpy()[:, None]
            q, c = shared.value.touched(xy - r, xy + r)
            other = c != t["cell"].to_numpy()[q]
            q, c = q[other], c[other]
            out = {"cell": c, "id": t["id"].to_numpy()[q], "x": xy[q, 0], "y": xy[q, 1], "r": r[q, 0]}
            box = shared.value.boxes[c]
            for i, name in enumerate(("left", "right", "below", "above")):  # the asked row lies there
                v = xy[q, i // 2]
                if i % 2:
                    out[name] = np.where(v >= box[:, i], v - out["r"], np.inf)
                else:
                    out[name] = np.where(v < box[:, i], v + out["r"], -np.inf)
            yield pa.RecordBatch.from_pydict(out)

    def across(key: tuple, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        near = k_nearest(
            points["x"].to_numpy(), points["y"].to_numpy(),
            queries["x"].to_numpy(), queries["y"].to_numpy(), k, queries["r"].to_numpy(),
        )
        ids = np.repeat(queries["id"].to_numpy(), near.shape[1])
        d = near.ravel()
        keep = d <= np.repeat(queries["r"].to_numpy(), near.shape[1])
        return pd.DataFrame({"id": ids[keep], "d": d[keep]})

    opened = first.where("open")
    ask = materialize(opened.select("cell", "id", "x", "y", "r").mapInArrow(
        asked, "cell bigint, id bigint, x double, y double, r double, "
        "left double, right double, below double, above double",
    ))
    reach = ask.groupBy("cell").agg(
        F.max("left").alias("left"), F.min("right").alias("right"),
        F.max("below").alias("below"), F.min("above").alias("above"),
    )
    points = first.join(F.broadcast(reach), "cell").where(
        "x <= left or x >= right or y <= below or y >= above"
    ).select("cell", "x", "y")
    found = (
        ask.select("cell", "id", "x", "y", "r").groupBy("cell")
        .cogroup(points.groupBy("cell"))
        .applyInPandas(across, "id bigint, d double")
        .groupBy("id")
        .agg(F.collect_list("d").alias("more"))
    )
    every = F.concat("near", F.coalesce("more", F.array().cast("array<double>")))
    exact = F.element_at(F.array_sort(every), k)
    asking = materialize(opened.join(found, "id", "left").select("id", "x", "y", exact.alias("r")))
    return first.where("not open").select("id", "x", "y", "r").unionByName(asking)


# -- the axes ------------------------------------------------------------------------


def axis_edges(sample: np.ndarray, parts: int) -> np.ndarray:
    """Limits of value ranges with about as many rows each; the sample decides nothing else."""
    if parts <= 1:
        return np.zeros(0)
    found = np.unique(np.quantile(sample, np.arange(1, parts + 1) / (parts + 1), method="nearest"))
    return (found[1:] + found[:-1]) / 2  # between values, so rounding cannot cross an edge


def _sum_digamma(radii: DataFrame, axis: str, edges: np.ndarray) -> float:
    """Sum of digamma(rows strictly closer than r on one axis, the row itself included)."""
    spark = radii.sparkSession
    shared = spark.sparkContext.broadcast(edges)

    def dealt(batches):
        """Rows to the range of their value, and interval ends beyond it to theirs."""
        for batch in batches:
            i, v, r = (c.to_numpy() for c in batch.columns)
            part = np.searchsorted(shared.value, v, side="right")
            for side in (0, 1, -1):
                to, at = part, slice(None)
                if side:
                    to = np.searchsorted(shared.value, v + side * r, side="right")
                    at = np.flatnonzero(to != part)
                yield pa.RecordBatch.from_pydict({
                    "part": to[at], "side": np.full(len(v[at]), side, np.int32), "id": i[at], "v": v[at], "r": r[at],
                })

    def ranks(key: tuple, table: pa.Table) -> pa.Table:
        """The ranks of ends whose row or other end is elsewhere; a row of side 0 sums up the rest."""
        part = key[0].as_py()
        side, ids, v, r = (table[c].to_numpy() for c in ("side", "id", "v", "r"))
        rows = np.flatnonzero(side == 0)
        rows = rows[np.argsort(v[rows])]
        points, out = v[rows], []
        here, n = np.ones(len(rows), bool), np.zeros(len(rows), np.int64)
        inner = {}
        for s in (1, -1):
            at = points + s * r[rows]
            inner[s] = np.searchsorted(shared.value, at, side="right") == part
            here &= inner[s]
        for s in (1, -1):
            q = np.concatenate([rows[inner[s]], np.flatnonzero(side == s)])
            found = closer_rank(points, v[q], r[q], v[q] + s * r[q], upper=s == 1)
            mine = np.flatnonzero(inner[s])
            n[mine] += s * found[:len(mine)]
            left = np.concatenate([~here[mine], np.ones(len(q) - len(mine), bool)])
            out.append((ids[q[left]], s, found[left]))
        # a neighbour at distance 0 leaves no row strictly closer, the row itself included
        total = float(digamma(np.maximum(n[here], 1).astype(float), np.log).sum())
        count = [len(i) for i, _, _ in out]
        return pa.table({
            "part": np.full(1 + sum(count), part),
            "side": np.repeat(np.array([0, 1, -1], np.int32), [1, *count]),
            "id": np.concatenate([[0], *(i for i, _, _ in out)]).astype(np.int64),
            "n": np.concatenate([[len(rows)], *(f for _, _, f in out)]).astype(np.int64),
            "total": np.concatenate([[total], np.zeros(sum(count))]),
        })

    sent = radii.select("id", axis, "r").mapInArrow(dealt, "part bigint, side int, id bigint, v double, r double")
    counted = materialize(
        sent.groupBy("part").applyInArrow(ranks, "part bigint, side int, id bigint, n bigint, total double")
    )
    sums = sorted(counted.where("side = 0").select("part", "n", "total").collect())
    total = math.fsum(row["total"] for row in sums)
    before = np.cumsum([0, *(row["n"] for row in sums)]).tolist()
    starts = spark.createDataFrame(
        [(row["part"], start) for row, start in zip(sums, before[:-1], strict=True)], "part bigint, start bigint"
    )
    ends = counted.where("side <> 0").join(F.broadcast(starts), "part")
    apart = ends.groupBy("id").agg(F.sum(F.col("side") * (F.col("n") + F.col("start"))).cast("double").alias("n"))
    return total + (apart.agg(F.sum(digamma(F.greatest("n", F.lit(1.0))))).first()[0] or 0.0)


def closer_rank(points, center, r, at, upper: bool) -> np.ndarray:
    """How many sorted points lie below an interval end, deciding by the distance itself:
    ``point - center < r`` for the upper end, ``center - point >= r`` for the lower one."""
    found = np.searchsorted(points, at, side="left")
    padded = np.concatenate([[-np.inf], points, [np.inf]])

    def counted(i):
        return (padded[i] - center < r) if upper else (center - padded[i] >= r)

    while True:
        back = (found > 0) & ~counted(found)
        ahead = (found < len(points)) & counted(found + 1)
        if not (back | ahead).any():
            return found
        found = np.where(back, found - 1, np.where(ahead, found + 1, found))
