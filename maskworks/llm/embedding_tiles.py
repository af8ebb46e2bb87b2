"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are turned into the principal axes of all of them, so that the first components carry most of
their products. Within each label they are dealt to tiles of neighbours in the leading components. Two
tiles meet only if their boxes in those components come close enough for the threshold. In a pair of
tiles, products are accumulated over leading components; the products of the rest are bounded by the
norms of the suffixes, and a pair is left as soon as it cannot reach the threshold. What remains is
decided by the cosine of the vectors themselves in double precision.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written

THRESHOLD = 0.93
TILE = 1024
#: Components after which the bound is tried, and those whose boxes decide which tiles meet.
STEPS = (4, 8, 16, 32)
BOX = 6
_PARTS = 64


def _matrix(column, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: a label, and a vector that is not null, empty, zero or with null or non-finite components."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where("label is not null and v is not null").where(F.size("v") > 0).where(good)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """The axes of the second moments of all unit vectors of a dimension, strongest first (dim x dim, columns)."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        part = TaskContext.get().partitionId() % _PARTS
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])

    def add(table):
        total = sum((np.frombuffer(x.as_buffer()) for x in table["m"]), np.zeros(dim * dim))
        return pa.table({"part": table["part"].slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

    got = vectors.select("v").mapInArrow(moments, "part int, m binary").groupBy("part").applyInArrow(add, "part int, m binary").toArrow()
    total = sum((np.frombuffer(x.as_buffer()) for x in got["m"]), np.zeros(dim * dim)).reshape(dim, dim)
    values, axes = np.linalg.eigh(total)
    return axes[:, np.argsort(-values)]


def _tiles(vectors: DataFrame, axes, dim: int) -> DataFrame:
    """(tile, rep, n, label, v, low, high): vectors ordered by coarse leading components and cut into tiles with their boxes."""
    width = min(BOX, dim)

    def leading(batches):
        for batch in batches:
            x = _matrix(batch.column(3), dim)
            x /= np.abs(x).max(axis=1, keepdims=True)
            p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes.value[:, :width]
            # Cells of a third of a unit in the leading components, and the first component itself within a cell.
            cell = np.zeros(len(p), np.int64)
            for j in range(min(4, width)):
                cell = cell * 8 + np.clip(((p[:, j] + 1) * 3).astype(np.int64), 0, 7)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(p[:, 0].copy()), pa.array(list(p), pa.list_(pa.float64()))], names=[*batch.schema.names, "cell", "lead", "p"])

    projected = vectors.select("rep", "n", "label", "v").mapInArrow(leading, "rep long, n long, label string, v array<double>, cell long, lead double, p array<double>")
    ordered = projected.repartitionByRange("label", "cell", "lead").sortWithinPartitions("label", "cell", "lead")

    def cut(batches):
        part, tile, size, label, cell = TaskContext.get().partitionId(), -1, 0, None, None
        for batch in batches:
            labels, cells = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            out = np.empty(len(labels), np.int64)
            for i, (x, c) in enumerate(zip(labels, cells, strict=True)):
                if tile < 0 or x != label or size >= TILE or (c != cell and size >= TILE // 4):
                    tile, size = tile + 1, 0
                label, cell, size = x, c, size + 1
                out[i] = (part << 32) + tile
            yield pa.RecordBatch.from_arrays([pa.array(out), *(batch.column(i) for i in (0, 1, 2, 3, 6))], names=["tile", "rep", "n", "label", "v", "p"])

    return written(ordered.mapInArrow(cut, "tile long, rep long, n long, label string, v array<double>, p array<double>"), "tiles")


def _meetings(tiles: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(i, j) of tiles of one label whose boxes are no further apart than vectors of the threshold can be."""
    ends = [f(F.get("p", F.lit(k))).alias(f"{name}{k}") for k in range(min(BOX, dim)) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = written(tiles.groupBy("label", "tile").agg(*ends), "boxes")
    left = boxes.select([F.col(c).alias(f"l_{c}") for c in boxes.columns])
    near = left.join(boxes, (F.col("l_label") == F.col("label")) & (F.col("l_tile") <= F.col("tile")))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"l_lo{k}") - F.col(f"hi{k}"), F.col(f"lo{k}") - F.col(f"l_hi{k}")), 2) for k in range(min(BOX, dim))), F.lit(0.0))
    return near.where(gap <= 2 - 2 * threshold + 1e-9).select(F.col("l_tile").alias("i"), F.col("tile").alias("j"))


def _reaching(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit vectors reach the threshold, with ``px`` and ``py`` the same in principal axes."""
    dim = px.shape[1]
    alive_x, alive_y = np.arange(len(x)), np.arange(len(y))
    total, done = np.zeros((len(x), len(y))), 0
    for step in [s for s in STEPS if s < dim]:
        total += px[alive_x, done:step] @ py[alive_y, done:step].T
        rest = np.linalg.norm(px[alive_x, step:], axis=1)[:, None] * np.linalg.norm(py[alive_y, step:], axis=1)[None, :]
        possible = total + rest >= threshold - 1e-9
        keep_x, keep_y = possible.any(axis=1), possible.any(axis=0)
        alive_x, alive_y, total, possible, done = alive_x[keep_x], alive_y[keep_y], total[keep_x][:, keep_y], possible[keep_x][:, keep_y], step
        if not len(alive_x):
            break
        if possible.mean() < 0.02:  # few pairs are left: each by itself
            a, b = np.nonzero(possible)
            out = np.zeros((len(x), len(y)), bool)
            for c in range(0, len(a), 100_000):
                i, j = alive_x[a[c : c + 100_000]], alive_y[b[c : c + 100_000]]
                out[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
            return out
    out = np.zeros((len(x), len(y)), bool)
    if len(alive_x):
        out[np.ix_(alive_x, alive_y)] = x[alive_x] @ y[alive_y].T >= threshold
    return out


def _forest(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row of its component."""
    label = np.arange(len(links))
    while True:
        least = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _compared(met: DataFrame, axes, dim: int, threshold: float) -> DataFrame:
    """(a, b, links): for each vector with links in a pair of tiles the weight of those, and edges that connect what they connect."""

    def compare(table):
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        rep, n, tile = (table[c].to_numpy() for c in ("rep", "n", "tile"))
        v = _matrix(table["v"], dim)
        v /= np.abs(v).max(axis=1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        p = v @ axes.value
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        reach = _reaching(v[left], v[right], p[left], p[right], threshold)
        if i == j:
            reach |= reach.T
            np.fill_diagonal(reach, False)
            whole, rows = reach, left
            weight = [(left, reach @ n[right])]
        else:
            rows = np.concatenate([left, right])
            whole = np.zeros((len(rows), len(rows)), bool)
            whole[: len(left), len(left) :] = reach
            whole |= whole.T
            weight = [(left, reach @ n[right]), (right, reach.T @ n[left])]
        root = _forest(whole) if reach.any() else np.arange(len(rows))
        hung = np.flatnonzero(root != np.arange(len(rows)))
        a = np.concatenate([rep[r][w > 0] for r, w in weight] + [rep[rows[hung]]])
        links = np.concatenate([w[w > 0] for _, w in weight] + [np.zeros(len(hung), np.int64)])
        own = np.concatenate([rep[r][w > 0] for r, w in weight] + [rep[rows[root[hung]]]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(own, pa.int64()), "links": pa.array(links, pa.int64())})

    return met.groupBy("i", "j").applyInArrow(compare, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``vectors``.

    Rows link when their labels are equal and their cosine is at least ``threshold``. Rows with a null label
    or with a vector that is null, empty, zero or holds null or non-finite components link with nothing;
    vectors of different dimension neither. Equal vectors of a label are compared once and then count as
    many. ``component_id`` is the smallest key reachable by links, ``kept`` whether that is the row's own.
    The key is an integer; rows that repeat a key are vectors of their own, and null keys stand alone.
    Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    able = usable(rows).where("key is not null")
    # Equal vectors meet by a digest; those with an equal digest are told apart by the vectors themselves.
    firsts = written(able.groupBy("label", "v").agg(F.min("key").alias("rep_key"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    parts = []
    for (dim,) in firsts.select(F.size("v").alias("dim")).distinct().collect():
        own = firsts.where(F.size("v") == dim)
        axes = spark.sparkContext.broadcast(principal_axes(own, dim))
        tiles = _tiles(own, axes, dim)
        meetings = written(_meetings(tiles, dim, threshold), "meetings")
        ends = meetings.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
        met = ends.join(tiles.select("tile", "rep", "n", "v"), "tile")
        parts.append(written(_compared(met, axes, dim, threshold), "links"))
    links = parts[0] if parts else spark.createDataFrame([], "a long, b long, links long")
    for more in parts[1:]:
        links = links.unionByName(more)
    counted = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = written(components(links.where("a <> b")), "components")
    placed = firsts.join(counted, "rep", "left").join(joined, firsts["rep"] == joined["node"], "left")
    placed = placed.select("label", "v", "rep_key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("rep_key").alias("component_id"))
    by_vector = placed.join(least, "comp").select("label", "v", "links", "component_id")
    out = rows.join(by_vector.withColumn("able", F.lit(True)), ["label", "v"], "left")
    mine = F.col("able") & F.col("key").isNotNull()
    return out.select(
        F.col("key").alias(key),
        F.when(mine, F.col("links")).otherwise(0).cast("long").alias("n_links"),
        F.when(mine, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
