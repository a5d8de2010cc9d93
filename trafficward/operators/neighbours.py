"""Exact nearest-neighbour and radius joins over vectors, partitioned by pivots.

Points go to the cell of their nearest pivot. The triangle inequality gives a lower
bound on the distance from a point to every cell, and a point is compared with the cells whose
bound does not exceed its search radius only; no candidate is dropped otherwise, so results are
exact. Cells are cut into blocks of bounded size by hash.

Blocks are put into some 16 packs (more from a million points on), each one row of a stored table.
Every two packs meet in one task, by a product of two tables that reads both sides where they are stored: vectors
are shuffled once, however many packs they meet. A task returns at most k rows per point,
a count, or a spanning forest, never all pairs unless all are asked for.

Vectors are array<double> columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import settle

MAX_PIVOTS = 2048
#: Packs that a table is cut into, while none gets larger than that many points.
PACKS, PACK_ROWS = 16, 65_536
#: Which packs meet: a pack with itself, with all others, or any two of them one way only, the later one on the right.
OWN, OTHERS, ONCE = "q_pack = pack", "q_pack <> pack", "q_pack <= pack"
#: Rows of a result handed on at once.
_ROWS = 250_000
#: Entries of a product of vectors held at once: a block is compared slice by slice.
_ENTRIES = 4_000_000


@dataclass
class Cells:
    """Pivots, and the smallest and largest distance of a point in its cell to the pivot."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def reach(self, vectors: np.ndarray, gaps: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Lower bounds on the distance from each vector, `gaps` from its own pivot, to the points of the cells.

        They are lowered a little, for rounding.
        """
        away = _distances(vectors, self.pivots[cells])
        floor = np.maximum.reduce([(away - gaps[:, None]) / 2.0, away - self.high[cells], self.low[cells] - away])
        return floor - 1e-9 * (1.0 + np.abs(away))


@dataclass
class Grid:
    """Points placed in cells: (rep, vec, weight, cell, gap, block, pack), with the cell bounds."""

    points: DataFrame
    packs: int
    cells: Cells
    copies: bool

    @property
    def pivots(self) -> np.ndarray:
        return self.cells.pivots


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by direct differences, in slices that keep memory flat."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def _products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and a bound on their error (not finite if they may not be).

    The vectors are moved to the mean of `b` first. Entries of a product of d terms are off by at most some d units in
    the last place of the norms; the bound is four times that.
    """
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = 4.0 * (a.shape[1] + 8) * np.finfo(float).eps * (aa.max(initial=0.0) + bb.max(initial=0.0))
    # the norms are two more terms of the product
    left = np.column_stack([-2.0 * a, aa, np.ones(len(a))])
    right = np.column_stack([b, np.ones(len(b)), bb])
    return left @ right.T, float(error) if np.isfinite(8.0 * (aa.max(initial=0.0) + bb.max(initial=0.0))) else math.inf


def _pair_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Euclidean distances of chosen pairs by direct differences."""
    out = np.empty(len(rows))
    step = max(1, 2_000_000 // max(1, a.shape[1]))
    for i in range(0, len(rows), step):
        out[i : i + step] = np.sqrt(((a[rows[i : i + step]] - b[columns[i : i + step]]) ** 2).sum(axis=1))
    return out


def distances_by_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances to some ten digits; those that a product tells less well come from differences."""
    square, error = _products(a, b)
    if not math.isfinite(error):
        return _distances(a, b)
    rows, columns = np.nonzero(square < 1e10 * error)
    out = np.sqrt(np.maximum(square, 0.0, out=square), out=square)
    out[rows, columns] = _pair_distances(a, b, rows, columns)
    return out


def _slices(a: np.ndarray, b: np.ndarray) -> Iterator[slice]:
    """Slices of the rows of `a` whose product with `b` stays small."""
    step = max(1, _ENTRIES // max(1, len(b)))
    return (slice(i, i + step) for i in range(0, len(a), step))


def within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Which distances are at most `radius`, as direct differences tell: a product settles all but those next to it."""
    out = np.empty((len(a), len(b)), bool)
    for part in _slices(a, b):
        out[part] = _slice_within(a[part], b, radius)
    return out


def _slice_within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    square, error = _products(a, b)
    if not math.isfinite(error):
        return _distances(a, b) <= radius
    if radius < 0:
        return np.zeros(square.shape, bool)
    limit = radius * radius
    slack = error + 1e-12 * limit
    near, sure = square <= limit + slack, square <= limit - slack
    if np.count_nonzero(near) > np.count_nonzero(sure):
        rows, columns = np.nonzero(near & ~sure)
        near[rows, columns] = _pair_distances(a, b, rows, columns) <= radius
    return near


def collapse(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (rep = smallest id, vec, weight) and the members (rep, id) of each."""
    points = df.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    members = df.join(points.select("vec", "rep"), "vec").select("rep", "id")
    return points, members


def build_grid(points: DataFrame, cell_size: int = 1024) -> Grid:
    """Choose pivots by hash, place every point, split cells into blocks of about `cell_size`, and blocks into packs.

    From 4,096 points on, cells and blocks grow with the square root of the number of points.
    """
    spark = points.sparkSession
    points = settle(points)
    size = points.count()
    pack_size = pack_rows(size, 8 * cell_size)
    cell_size = math.ceil(max(cell_size, cell_size * math.sqrt(size) / 64))
    wanted = int(min(MAX_PIVOTS, max(1, math.ceil(size / cell_size))))
    chosen = points.select("vec").orderBy(F.md5(F.col("rep").cast("string")), "rep").limit(wanted).collect()
    pivots = np.array([r.vec for r in chosen], dtype=float)

    @F.pandas_udf("struct<cell:int,gap:double>")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        away = _distances(np.stack(vec.to_numpy()), pivots)
        cell = away.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "gap": away[np.arange(len(cell)), cell]})

    placed = settle(points.withColumn("_at", nearest("vec")).select("rep", "vec", "weight", "_at.*"))
    bounds = (
        placed.groupBy("cell")
        .agg(
            F.count("*").alias("n"),
            F.min("gap").alias("low"),
            F.max("gap").alias("high"),
            F.max("weight").alias("weight"),
        )
        .collect()  # one row per pivot
    )
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    rows, pack, held = [], 0, 0.0
    for b in sorted(bounds, key=lambda b: b.cell):
        low[b.cell], high[b.cell] = b.low, b.high
        blocks = math.ceil(b.n / min(cell_size, pack_size / 8))
        packs = []
        for _ in range(blocks):
            if held and held + b.n / blocks > pack_size:
                pack, held = pack + 1, 0.0
            packs.append(pack)
            held += b.n / blocks
        rows.append((b.cell, packs))
    cells = spark.createDataFrame(rows, "cell int, packs array<int>")
    block = F.pmod(F.xxhash64("rep"), F.size("packs")).cast("int")
    placed = placed.join(F.broadcast(cells), "cell").withColumn("block", block)
    placed = placed.withColumn("pack", F.get("packs", "block")).drop("packs")
    return Grid(placed, pack + 1, Cells(pivots, low, high), any(b.weight > 1 for b in bounds))


def pack_rows(rows: int, least: int) -> int:
    """Rows of a pack: a share of all, so that few tasks and few results of one row meet, within bounds."""
    return min(max(least, math.ceil(rows / PACKS)), max(least, PACK_ROWS))


def _matrix(rows: pa.Table) -> np.ndarray:
    """The column `vec` as a matrix."""
    lists = rows.column("vec").combine_chunks()
    width = pc.min_max(pc.list_value_length(lists)).as_py()
    if width["min"] != width["max"]:
        raise ValueError("vectors must be of one length")
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    return flat.astype(float, copy=False).reshape(len(lists), -1)


def packed(rows: DataFrame, packs: int, order: str) -> DataFrame:
    """The rows of each `pack` (0 to `packs` - 1) as one value, in the order of a column, each in a partition of its own."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.take(pc.sort_indices(table, [(order, "ascending")]))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        pack = table.column("pack")[0].as_py()
        yield pa.RecordBatch.from_pylist(
            [{"pack": pack, "data": sink.getvalue().to_pybytes()}], pa.schema([("pack", pa.int32()), ("data", pa.binary())])
        )

    alone = rows.withColumn("pack", F.col("pack").cast("int")).repartitionById(packs, F.col("pack"))
    return settle(alone.mapInArrow(bundle, "pack int, data binary"))


def compare_packs(left: DataFrame, right: DataFrame, kernel: Callable, schema: str, meet: str = "true") -> DataFrame:
    """Run `kernel(left rows, right rows, whether they are the same pack)`, which yields tables, on pairs of packs.

    `meet` is a condition on (q_pack, pack). A task reads its two packs where they are stored; nothing is shuffled.
    """
    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    given = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, s = (pa.ipc.open_stream(batch.column(c)[i].as_buffer()).read_all() for c in ("q_data", "data"))
                for found in kernel(q, s, batch.column("q_pack")[i] == batch.column("pack")[i]):
                    yield from found.select(given.names).cast(given).to_batches(max_chunksize=_ROWS)

    # both sides may descend from one table: fresh names keep their columns apart
    asked = left.select(*[F.col(c).alias(f"q_{c}") for c in left.columns])
    others = right.select(*[F.col(c).alias(c) for c in right.columns])
    if left is right and meet == OWN:
        both = left.select(F.col("pack").alias("q_pack"), F.col("data").alias("q_data"), "pack", "data")
    else:
        both = asked.crossJoin(others.hint("shuffle_replicate_nl")).where(F.expr(meet))
    return both.mapInArrow(run, schema)


def _sections(rows: pa.Table) -> list[tuple[int, slice]]:
    """The cells of a pack and where their rows are."""
    cell = rows.column("cell").to_numpy()
    found, first = np.unique(cell, return_index=True)
    return [(int(c), slice(i, j)) for c, i, j in zip(found, first, [*first[1:], len(cell)])]


def near_sections(cells: Cells, q: pa.Table, s: pa.Table, radius: float) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """(rows of q, rows of s, which are within the radius) for bounded parts of two packs; parts without a hit are left out."""
    a, b, gaps = _matrix(q), _matrix(s), q.column("gap").to_numpy()
    sections = _sections(s)
    floor = cells.reach(a, gaps, np.array([c for c, _ in sections]))
    for k, (_, part) in enumerate(sections):
        asking = np.flatnonzero(floor[:, k] <= radius)
        target = b[part]
        for i in _slices(asking, target):
            hit = _slice_within(a[asking[i]], target, radius)
            if hit.any():
                yield asking[i], part, hit


def _ranked(rows: np.ndarray, theirs: np.ndarray, away: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row, ties by number, ordered by row and rank."""
    order = np.lexsort((theirs, away, rows))
    rows, theirs, away = rows[order], theirs[order], away[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], theirs[kept], away[kept]


def _closest_rows(a: np.ndarray, b: np.ndarray, mine: np.ndarray, theirs: np.ndarray, bound: np.ndarray, k: int):
    """(row of `a`, number of its neighbour, distance): the k nearest of `b`, those beyond `bound` left out."""
    found = []
    for part in _slices(a, b):
        square, error = _products(a[part], b)
        if not math.isfinite(error):
            square, error = _distances(a[part], b) ** 2, 0.0
        if np.isin(mine[part], theirs).any():
            square[mine[part][:, None] == theirs[None, :]] = np.inf
        # whatever may be among the k nearest, with the error of the product; direct differences rank it
        limit = bound[part] * bound[part]
        free = np.flatnonzero(~np.isfinite(limit))
        if len(free):
            last = min(k, square.shape[1]) - 1
            limit[free] = np.partition(square if len(free) == len(square) else square[free], last, axis=1)[:, last]
        reach = np.minimum(limit + 2 * error + 1e-12 * np.abs(limit), np.finfo(float).max)
        rows, columns = np.nonzero(square <= reach[:, None])
        away = _pair_distances(a[part], b, rows, columns)
        rows, others, away = _ranked(rows, theirs[columns], away, k)
        found.append((rows + part.start, others, away))
    return tuple(np.concatenate(c) for c in zip(*found))


def _closest(k: int) -> Callable:
    def kernel(q: pd.DataFrame, s: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([q.rep.to_numpy(), s.rep.to_numpy()]), return_inverse=True)
        bound = q.bound.to_numpy(float) if "bound" in q else np.full(len(q), np.inf)
        rows, others, away = _closest_rows(a, b, codes[: len(q)], codes[len(q) :], bound, k)
        return pd.DataFrame({"rep": q.rep.to_numpy()[rows], "other": names[others], "distance": away})

    return kernel


def _first(df: DataFrame, key: str, other: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy("distance", other)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pack_neighbours(cells: Cells, k: int) -> Callable:
    """A kernel of `compare_packs`: the k nearest of one pack to each row of another, those beyond `bound` left out.

    Sections are compared one after the other, the own one first; the k-th distance so far bounds those after it.
    """

    def kernel(q: pa.Table, s: pa.Table, same: bool) -> Iterator[pa.Table]:
        a, b, gaps = _matrix(q), _matrix(s), q.column("gap").to_numpy()
        names, codes = np.unique(np.concatenate([x.column("rep").to_numpy(zero_copy_only=False) for x in (q, s)]), return_inverse=True)
        mine, theirs, names = codes[: len(q)], codes[len(q) :], pa.array(names, pa.string())
        given = q.column("bound").to_numpy() if "bound" in q.column_names else np.full(len(q), np.inf)
        targets = _sections(s)
        floor = cells.reach(a, gaps, np.array([c for c, _ in targets]))
        for home, rows in _sections(q):
            bound, best = given[rows].copy(), (np.empty(0, int), np.empty(0, int), np.empty(0))
            for t in sorted(range(len(targets)), key=lambda t: (targets[t][0] != home, floor[rows, t].min())):
                asking, part = np.flatnonzero(floor[rows, t] <= bound), targets[t][1]
                if not len(asking):
                    continue
                at, others, away = _closest_rows(a[rows][asking], b[part], mine[rows][asking], theirs[part], bound[asking], k)
                best = _ranked(*(np.concatenate(c) for c in zip(best, (asking[at], others, away))), k)
                last = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
                bound[best[0][last]] = np.minimum(bound[best[0][last]], best[2][last])
            columns = [names.take(pa.array(mine[rows][best[0]])), names.take(pa.array(best[1])), pa.array(best[2])]
            yield pa.table(columns, names=["rep", "other", "distance"])

    return kernel


def nearest_neighbours(df: DataFrame, k: int, cell_size: int = 1024) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest others of every id, ties by id.

    Equal vectors are collapsed first, so a group of copies of any size is one point with a weight.
    First every point searches its own pack, which bounds its k-th distance; then it visits only the cells of other
    packs that could beat the bound. `df` has id (string) and vec.
    """
    points, members = collapse(df.select(F.col("id").cast("string").alias("id"), "vec"))
    grid = build_grid(points, cell_size)
    schema = "rep string, other string, distance double"
    fields = ["rep", "vec", "cell", "gap", "pack"]
    targets = packed(grid.points.select(*fields), grid.packs, "cell")
    kernel = _pack_neighbours(grid.cells, k)
    found = compare_packs(targets, targets, kernel, schema, OWN)
    if grid.packs > 1:
        found = settle(found)
        bound = (
            _first(found, "rep", "other", k)
            .groupBy("rep")
            .agg(F.max("distance").alias("_d"), F.count("*").alias("_n"))
            .select("rep", F.when(F.col("_n") >= k, F.col("_d")).alias("bound"))
        )
        bounded = grid.points.select(*fields).join(bound, "rep", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        found = found.unionByName(compare_packs(packed(bounded, grid.packs, "cell"), targets, kernel, schema, OTHERS))
    ranked = _first(found, "rep", "other", k)
    if not grid.copies:
        return ranked.select(F.col("rep").alias("id"), F.col("other").alias("neighbour"), "distance", "rank")
    # at most k + 1 ids of a group of copies can appear in anyone's list
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    listed = members.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).drop("_nth")
    own = listed.select("rep", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"))
    others = ranked.join(listed.withColumnRenamed("rep", "other"), "other").select(
        "rep", F.col("id").alias("neighbour"), "distance"
    )
    shared = _first(own.unionByName(others), "rep", "neighbour", k + 1).drop("rank")
    expanded = members.join(shared, "rep").where(F.col("id") != F.col("neighbour"))
    return _first(expanded, "id", "neighbour", k).select("id", "neighbour", "distance", "rank")


def _equal_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row number of each distinct row, all row numbers sorted by distinct row, and where each one's begin."""
    x = np.ascontiguousarray(x)
    _, kept, code = np.unique(x.view(f"V{x.itemsize * max(1, x.shape[1])}").ravel(), return_index=True, return_inverse=True)
    order = np.argsort(code, kind="stable")
    return kept, order, np.searchsorted(code[order], np.arange(len(kept) + 1))


def _products_of_groups(i: np.ndarray, j: np.ndarray, left: tuple, right: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, row, row) of all members of the i-th and the j-th group, for slices of bounded size."""
    (mine, begin), (theirs, start) = left, right
    wide = start[j + 1] - start[j]
    ends = np.cumsum((begin[i + 1] - begin[i]) * wide)
    for low in range(0, int(ends[-1]) if len(ends) else 0, _ROWS):
        at = np.arange(low, min(low + _ROWS, int(ends[-1])))
        pair = np.searchsorted(ends, at, side="right")
        inside = at - np.where(pair > 0, ends[pair - 1], 0)
        yield pair, mine[begin[i[pair]] + inside // wide[pair]], theirs[start[j[pair]] + inside % wide[pair]]


def pairs_within(df: DataFrame, radius: float, cell_size: int = 1024) -> DataFrame:
    """(id_a, id_b, distance, copies_a, copies_b), id_a < id_b: every two ids whose vectors are within a radius.

    Copies of a vector are ids like others, paired with each other and each with all that is near: a row stands for
    one pair, so `copies_*` are 1. Inside a pack a vector is compared once, whatever the number of its copies.
    """
    points = df.select(F.col("id").cast("string").alias("rep"), "vec", F.lit(1).cast("bigint").alias("weight"))
    grid = build_grid(points.where(F.col("rep").isNotNull()), cell_size)
    cells = grid.cells

    def kernel(q: pa.Table, s: pa.Table, same: bool) -> Iterator[pa.Table]:
        names = np.concatenate([x.column("rep").to_numpy(zero_copy_only=False) for x in (q, s)])
        codes = np.unique(names, return_inverse=True)[1]
        mine, theirs, names = codes[: len(q)], codes[len(q) :], pa.array(names, pa.string())
        a, b = _matrix(q), _matrix(s)
        kept, order, begin = _equal_rows(a)
        once = q.take(pa.array(kept))
        for part in _sections(s):
            target = s.slice(part[1].start, part[1].stop - part[1].start)
            own, their_order, start = _equal_rows(b[part[1]])
            single = target.take(pa.array(own))
            left, right = a[kept], b[part[1]][own]
            for rows, _, hit in near_sections(cells, once, single, radius):
                i, j = np.nonzero(hit)
                i = rows[i]
                away = _pair_distances(left, right, i, j)
                for pair, x, y in _products_of_groups(i, j, (order, begin), (their_order, start)):
                    y = y + part[1].start
                    keep = mine[x] < theirs[y] if same else mine[x] != theirs[y]
                    pair, x, y = pair[keep], x[keep], y[keep]
                    swap = mine[x] > theirs[y]
                    first, second = np.where(swap, len(q) + y, x), np.where(swap, x, len(q) + y)
                    single_rows = pa.array(np.ones(len(pair), np.int64))
                    columns = [names.take(pa.array(first)), names.take(pa.array(second)), pa.array(away[pair]), single_rows, single_rows]
                    yield pa.table(columns, names=["id_a", "id_b", "distance", "copies_a", "copies_b"])

    stored = packed(grid.points.select("rep", "vec", "cell", "gap", "pack"), grid.packs, "cell")
    return compare_packs(
        stored, stored, kernel, "id_a string, id_b string, distance double, copies_a bigint, copies_b bigint", ONCE
    )
