"""Products of matrices (i, j, v) and batches (b, i, j, v): an equi-join of elements, or tiles that meet on a grid.

The contracted index alone would be a poor key: a long and thin product has few values of it, under which all elements meet.  So tiles of
``TILE`` x ``TILE`` elements are dealt to cells (rows of C, columns of C, depth): a cell covers ``SIDE`` x ``SIDE`` tiles of C over ``DEEP``
tiles of the contracted index.  A tile of A goes to every column of cells, one of B to every row, and a task streams its cells tile after
tile, adding to at most ``SIDE`` * ``SIDE`` tiles of C, which leave it once a cell.  Wide products get many cells by their rows and
columns, and tall ones by their depth; sums over depth combine before the shuffle.

Up to ``SHALLOW`` contracted indices a cell holds all of its rows of A and takes strips of columns of B one after another: its elements
of C are complete as they leave it, so that C, the largest of the three, is never shuffled.  Such cells are wide, about ``CELLS`` of them:
operands are sent some ``sqrt(CELLS)`` times, whatever the size of C.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.strategy import TILE, product_strategy, shape

SIDE, DEEP = 4, 16
#: Of a shallow product: the largest depth, the number of cells, the elements of C that a cell has at least, those of A that it holds, those of C
#: that it holds at once, and the most tasks.
SHALLOW, CELLS, LEAST, PANEL, STRIP, MOST = 1024, 36, 1 << 16, 1 << 20, 1 << 21, 10_000


def batched(df: DataFrame) -> list[str]:
    return ["b"] if "b" in df.columns else []


def _elements(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(*batched(a), "i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(*batched(b), F.col("i").alias("k"), "j", F.col("v").alias("y"))
    on = ["k", *(c for c in batched(left) if c in right.columns)]
    keys = list(dict.fromkeys([*batched(left), *batched(right), "i", "j"]))
    return left.join(right, on).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("p"))


def _tiles(df: DataFrame, tile: int) -> DataFrame:
    """bi, bj, at (place in the tile), x: a row per tile, of tile * tile elements at most."""
    block = lambda c: (F.col(c) / tile).cast("long")
    inner = F.struct((F.pmod("i", F.lit(tile)) * tile + F.pmod("j", F.lit(tile))).cast("int").alias("at"), "v")
    return df.groupBy(block("i").alias("bi"), block("j").alias("bj")).agg(F.collect_list(inner).alias("x")).select("bi", "bj", F.col("x.at").alias("at"), F.col("x.v").alias("x"))


def _grid(a: DataFrame, b: DataFrame, m: int, n: int, k: int, tile: int) -> DataFrame:
    blocks = lambda size: max(1, -(-size // tile))
    rows, cols = (-(-blocks(x) // SIDE) for x in (m, n))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    cell = lambda c, by: (F.col(c) / by).cast("int")

    def dealt(tiles: DataFrame, side: int, ci: Column, cj: Column, depth: str, other: str) -> DataFrame:
        return tiles.select(ci.alias("ci"), cj.alias("cj"), cell(depth, DEEP).alias("ck"), F.col(depth).alias("bk"), F.lit(side).alias("side"), F.col(other).alias("bo"), "at", "x")

    left = dealt(_tiles(a, tile), 0, cell("bi", SIDE), every(cols), "bj", "bi")
    right = dealt(_tiles(b, tile), 1, every(rows), cell("bj", SIDE), "bi", "bj")
    order = ["ci", "cj", "ck", "bk", "side", "bo"]
    met = left.unionByName(right).repartition("ci", "cj", "ck").sortWithinPartitions(*order)

    def multiply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, layer, lefts, sums = None, None, [], {}

        def settled() -> pa.RecordBatch:
            out = [(bi, bj, p.shape[1], p.ravel()) for (bi, bj), p in sums.items()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], ["bi", "bj", "cols", "data"])

        for batch in parts:
            keys = list(zip(*(batch.column(c).to_pylist() for c in order), strict=True))
            for r, (ci, cj, ck, bk, side, bo) in enumerate(keys):
                if (ci, cj, ck) != current:
                    if sums:
                        yield settled()
                    current, layer, lefts, sums = (ci, cj, ck), None, [], {}
                if bk != layer:
                    layer, lefts = bk, []
                at, v = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("at", "x"))
                x = np.zeros((int(at.max()) // tile + 1, int((at % tile).max()) + 1))
                x[at // tile, at % tile] = v
                if side == 0:
                    lefts.append((bo, x))
                    continue
                for bi, y in lefts:
                    depth = min(y.shape[1], len(x))
                    p, old = y[:, :depth] @ x[:depth], sums.get((bi, bo))
                    if old is None:
                        sums[bi, bo] = p
                    else:
                        wide = np.zeros(np.maximum(p.shape, old.shape)) if p.shape != old.shape else old
                        if wide is not old:
                            wide[: old.shape[0], : old.shape[1]] = old
                        wide[: p.shape[0], : p.shape[1]] += p
                        sums[bi, bo] = wide
        if sums:
            yield settled()

    done = met.mapInArrow(multiply, "bi long, bj long, cols long, data array<double>").select("bi", "bj", "cols", F.posexplode("data").alias("pos", "v"))
    i, j = F.col("bi") * tile + (F.col("pos") / F.col("cols")).cast("long"), F.col("bj") * tile + F.pmod("pos", "cols")
    return done.groupBy(i.alias("i"), j.alias("j")).agg(F.sum("v").alias("p"))


def _spans(m: int, n: int, k: int, tile: int) -> tuple[int, int]:
    """Rows and columns of C in a cell of a shallow product, in tiles."""
    m, n, k = (max(1, x) for x in (m, n, k))
    area = max(LEAST, m * n // CELLS)
    side = math.isqrt(area)
    rows = area // n if n < side else m if m < side else side
    cols = area // m if m < side else n if n < side else side
    most = min(PANEL // k, STRIP // tile) // tile
    return max(1, min(-(-rows // tile), most)), max(1, -(-cols // tile))


def _panels(a: DataFrame, b: DataFrame, m: int, n: int, k: int, tile: int) -> DataFrame:
    blocks = lambda size: max(1, -(-size // tile))
    tall, wide = _spans(m, n, k, tile)
    every = lambda size, by: F.explode(F.sequence(F.lit(0), F.lit(-(-blocks(size) // by) - 1)))
    cell = lambda c, by: (F.col(c) / by).cast("int")

    def dealt(tiles: DataFrame, side: int, ci: Column, cj: Column, depth: str, other: str) -> DataFrame:
        return tiles.select(ci.alias("ci"), cj.alias("cj"), F.lit(side).alias("side"), F.col(other).alias("bo"), F.col(depth).alias("bk"), "at", "f", "x")

    def compact(tiles: DataFrame, height: int, width: int) -> DataFrame:
        """Sorted; a tile that holds each of its elements goes without their places, and values that single precision holds exactly go as such."""
        h, w = (F.least(F.lit(tile), F.lit(size) - F.col(c) * tile) for size, c in ((height, "bi"), (width, "bj")))
        ordered = tiles.withColumn("z", F.array_sort(F.arrays_zip("at", "x")))
        whole = F.transform(F.sequence(F.lit(0), (h * w - 1).cast("int")), lambda p: (F.floor(p / w) * tile + F.pmod(p, w)).cast("int"))
        full = (F.size("at") == h * w) & (F.col("z.at") == whole)
        single = F.forall("z.x", lambda v: v.cast("float").cast("double").eqNullSafe(v))
        f, x = F.when(single, F.col("z.x").cast("array<float>")), F.when(~single, F.col("z.x"))
        return ordered.select("bi", "bj", F.when(full, F.lit(None)).otherwise(F.col("z.at")).alias("at"), f.alias("f"), x.alias("x"))

    left = dealt(compact(_tiles(a, tile), m, k), 0, cell("bi", tall), every(n, wide), "bj", "bi")
    right = dealt(compact(_tiles(b, tile), k, n), 1, every(m, tall), cell("bj", wide), "bi", "bj")
    order = ["ci", "cj", "side", "bo", "bk"]
    # a task for each cell: the tiles are few bytes beside the elements they make, by which Spark would put cells together
    across = -(-blocks(n) // wide)
    cells = min(MOST, across * -(-blocks(m) // tall))
    met = left.unionByName(right).repartitionById(cells, F.pmod(F.col("ci").cast("long") * across + F.col("cj"), F.lit(cells)).cast("int")).sortWithinPartitions(*order)
    short = lambda size, block: min(tile, size - block * tile)

    def multiply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, panel, stacked, strip = None, {}, None, []

        def done(bo: int) -> pa.RecordBatch:
            """The cell's rows of the strip's columns, a row of the batch for each tile."""
            bis, layers = stacked
            width = short(n, bo)
            p = np.zeros((len(bis), tile, width))
            for bk, x in strip:
                if bk in layers:
                    places, y = layers[bk]
                    part = (y @ x).reshape(-1, tile, width)
                    if len(places) == len(bis):
                        p += part
                    else:
                        p[places] += part
            heights = [short(m, bi) for bi in bis]
            flat = p.reshape(-1) if heights[-1] == tile else p.reshape(-1)[: (heights[-1] - tile) * width]
            ends = np.concatenate(([0], np.cumsum(heights) * width)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(bis, pa.int64()), pa.array([bo] * len(bis), pa.int64()), pa.array([width] * len(bis), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))], ["bi", "bj", "cols", "data"])

        def stack() -> tuple[list[int], dict[int, tuple[np.ndarray, np.ndarray]]]:
            bis = sorted({bi for tiles in panel.values() for bi, _ in tiles})
            at = {bi: p for p, bi in enumerate(bis)}
            return bis, {bk: (np.array([at[bi] for bi, _ in tiles]), np.concatenate([y for _, y in tiles])) for bk, tiles in panel.items()}

        for batch in parts:
            keys = list(zip(*(batch.column(c).to_pylist() for c in order), strict=True))
            for r, (ci, cj, side, bo, bk) in enumerate(keys):
                if strip and (ci, cj, bo) != current:
                    yield done(current[2])
                    strip = []
                if current is None or (ci, cj) != current[:2]:
                    panel, stacked = {}, None
                current = (ci, cj, bo)
                places, single, values = (batch.column(c)[r].values for c in ("at", "f", "x"))
                height, width = (tile, short(k, bk)) if side == 0 else (short(k, bk), short(n, bo))
                x = np.zeros((height, width))
                values = (single if values is None else values).to_numpy(zero_copy_only=False)
                if places is None:
                    x.reshape(-1)[: len(values)] = values
                else:
                    places = places.to_numpy(zero_copy_only=False)
                    x[places // tile, places % tile] = values
                if side == 0:
                    panel.setdefault(bk, []).append((bo, x))
                elif panel:
                    stacked = stacked or stack()
                    strip.append((bk, x))
        if strip:
            yield done(current[2])

    out = met.mapInArrow(multiply, "bi long, bj long, cols long, data array<double>").select("bi", "bj", "cols", F.posexplode("data").alias("pos", "p"))
    return out.select((F.col("bi") * tile + (F.col("pos") / F.col("cols")).cast("long")).alias("i"), (F.col("bj") * tile + F.pmod("pos", "cols")).alias("j"), "p")


def product(a: DataFrame, b: DataFrame, strategy: str = "auto", tile: int = TILE, size: tuple[int, int, int] | None = None) -> DataFrame:
    """Keys, i, j, p of A B; an operand without a batch index is shared by all matrices of the other.

    ``size`` is (m, n, k); where it isn't given, the strategy and the grid ask for an aggregate over the operands.  Matrices of a batch are
    small, so their elements meet under (b, k).
    """
    if batched(a) or batched(b):
        return _elements(a, b)
    if strategy == "elements":
        return _elements(a, b)
    m, n, k = size or shape(a, b)
    if product_strategy(m, n, k, strategy) == "elements":
        return _elements(a, b)
    return (_panels if k <= SHALLOW else _grid)(a, b, m, n, k, tile)
