"""Elevation rasters as cell tables (row, col, value): neighbours, slope, flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.operators.stats import exact_percentiles
from hydrolake.session import cut_lineage

# Flow direction codes clockwise from north, with row and column step.
DIRECTIONS = [
    ("n", 64, -1, 0),
    ("ne", 128, -1, 1),
    ("e", 1, 0, 1),
    ("se", 2, 1, 1),
    ("s", 4, 1, 0),
    ("sw", 8, 1, -1),
    ("w", 16, 0, -1),
    ("nw", 32, -1, -1),
]
NODATA_BELOW = -100.0
SLOPE_EPS = 0.001


def neighbours(cells: DataFrame, value: str = "value", tile: int = 256) -> DataFrame:
    """Adds the eight neighbour values n, ne, e, ..., nw (NULL beyond the raster).

    Cells are cut into square tiles with a one-cell rim, so one shuffle by tile serves all eight.
    Inside a tile, a window along the row finds west and east, and a window along the column then
    carries those triples from the rows above and below. Every cell must be present as a row; cells
    without data hold NULL or a no-data value.
    """
    tr, tc = F.floor(F.col("row") / tile).cast("long"), F.floor(F.col("col") / tile).cast("long")
    in_r, in_c = F.pmod(F.col("row"), F.lit(tile)), F.pmod(F.col("col"), F.lit(tile))

    def reach(home: Column, place: Column) -> Column:
        return F.array_compact(
            F.array(home, F.when(place == 0, home - 1), F.when(place == tile - 1, home + 1))
        )

    base = (
        cells.withColumn("_tr", F.explode(reach(tr, in_r)))
        .withColumn("_tc", F.explode(reach(tc, in_c)))
        .withColumn("_own", (F.col("_tr") == tr) & (F.col("_tc") == tc))
    )
    along = W.partitionBy("_tr", "_tc", "row").orderBy("col")
    across = W.partitionBy("_tr", "_tc", "col").orderBy("row")

    def beside(field: Column, step: int, axis: str, w) -> Column:
        shifted = F.lag(field, 1).over(w) if step < 0 else F.lead(field, 1).over(w)
        place = F.lag(axis, 1).over(w) if step < 0 else F.lead(axis, 1).over(w)
        return F.when(place == F.col(axis) + step, shifted)

    v = F.col(value)
    base = base.withColumns({"w": beside(v, -1, "col", along), "e": beside(v, 1, "col", along)})
    triple = F.struct(F.col("w"), v.alias("m"), F.col("e"))
    base = base.withColumns({"_up": beside(triple, -1, "row", across), "_down": beside(triple, 1, "row", across)})
    named = base.where("_own").withColumns(
        {
            "nw": F.col("_up.w"), "n": F.col("_up.m"), "ne": F.col("_up.e"),
            "sw": F.col("_down.w"), "s": F.col("_down.m"), "se": F.col("_down.e"),
        }
    )
    return named.select(*cells.columns, *[name for name, *_ in DIRECTIONS])


def slope(cells: DataFrame, value: str = "value", tile: int = 256) -> DataFrame:
    """Slope in radians from central differences, one-sided at the raster edge, in cell units."""
    near = neighbours(cells, value, tile)

    def gradient(before: str, after: str) -> Column:
        a, b, m = F.col(before), F.col(after), F.col(value)
        return (
            F.when(a.isNotNull() & b.isNotNull(), (b - a) / 2.0)
            .when(b.isNotNull(), b - m)
            .when(a.isNotNull(), m - a)
            .otherwise(F.lit(0.0))
        )

    dy, dx = gradient("n", "s"), gradient("w", "e")
    return near.select(*cells.columns, F.atan(F.sqrt(dx * dx + dy * dy)).alias("slope"))


def d8(cells: DataFrame, value: str = "value", tile: int = 256) -> DataFrame:
    """Steepest-descent direction code per cell, 0 for pits, and the drop per cell width.

    Of equally steep neighbours the first clockwise from north wins. Cells without data neither send
    nor receive.
    """
    valid = cells.withColumn("_v", F.when(F.col(value) > NODATA_BELOW, F.col(value)))
    near = neighbours(valid, "_v", tile)
    options = [
        F.when(
            F.col(name).isNotNull() & (F.col("_v") > F.col(name)),
            F.struct(
                ((F.col("_v") - F.col(name)) / F.lit(2.0**0.5 if dr and dc else 1.0)).alias("drop"),
                F.lit(-i).alias("order"),
                F.lit(code).alias("code"),
                F.lit(dr).alias("dr"),
                F.lit(dc).alias("dc"),
            ),
        )
        for i, (name, code, dr, dc) in enumerate(DIRECTIONS)
    ]
    best = near.withColumn("_best", F.array_max(F.array_compact(F.array(*options))))
    return best.select(
        *cells.columns,
        F.when(F.col("_v").isNull(), F.lit(None)).otherwise(F.coalesce(F.col("_best.code"), F.lit(0))).cast("int").alias("direction"),
        F.coalesce(F.col("_best.drop"), F.lit(0.0)).alias("drop"),
        (F.col("row") + F.col("_best.dr")).alias("to_row"),
        (F.col("col") + F.col("_best.dc")).alias("to_col"),
    )


def cell_id(row: str | Column, column: str | Column) -> Column:
    r = F.col(row) if isinstance(row, str) else row
    c = F.col(column) if isinstance(column, str) else column
    return F.shiftleft(r.cast("long"), 32) + c.cast("long")


def flow_accumulation(directions: DataFrame) -> DataFrame:
    """Number of cells draining through each cell, itself included: (row, col, flow_accumulation).

    Pointer doubling: in round i a cell knows the total of the cells up to 2^i steps above it and
    points 2^i steps down. Rounds grow with the logarithm of the longest flow path. Every round is
    written to the shared folder, so lost executors cost one round. Cells whose pointer has run off
    the end of their path leave the join. A path cannot be longer than the number of cells, so
    directions that still lead on after that many steps hold a cycle, which is an error.
    """
    state = directions.where(F.col("direction").isNotNull()).select(
        cell_id("row", "col").alias("cell"),
        F.when(F.col("to_row").isNotNull(), cell_id("to_row", "to_col")).alias("down"),
        F.lit(1).cast("long").alias("acc"),
    )
    state = cut_lineage(state)
    steps, cells = 1, state.count()
    while not state.where(F.col("down").isNotNull()).isEmpty():
        if steps > cells:
            raise ValueError("the flow directions hold a cycle")
        steps *= 2
        moving = state.where(F.col("down").isNotNull())
        arrives = moving.groupBy(F.col("down").alias("cell")).agg(F.sum("acc").alias("_in"))
        jump = state.select(F.col("cell").alias("down"), F.col("down").alias("_next"))
        pointers = moving.join(jump, "down").select("cell", "_next")
        state = cut_lineage(
            state.drop("down")
            .join(arrives, "cell", "left")
            .join(pointers, "cell", "left")
            .select("cell", F.col("_next").alias("down"), (F.col("acc") + F.coalesce("_in", F.lit(0))).alias("acc"))
        )
    low = F.lit((1 << 32) - 1).cast("long")
    return state.select(
        F.shiftright("cell", 32).alias("row"), F.col("cell").bitwiseAND(low).alias("col"), F.col("acc").alias("flow_accumulation")
    )


def twi(cells: DataFrame, tile: int = 256, value: str = "value") -> DataFrame:
    """Slope, flow accumulation and wetness index ln((acc + 1) / tan(slope + 0.001)) per cell.

    The index is NULL beside no-data cells, where the slope is all but vertical and the tangent
    turns negative.
    """
    acc = flow_accumulation(d8(cells, value, tile))
    sloped = slope(cells, value, tile).join(acc, ["row", "col"], "left")
    a = F.coalesce(F.col("flow_accumulation"), F.lit(0))
    return sloped.withColumn("flow_accumulation", a).withColumn(
        "twi", F.ln((F.col("flow_accumulation") + 1) / F.tan(F.col("slope") + F.lit(SLOPE_EPS)))
    )


def zonal_percentiles(zones: DataFrame, cells: DataFrame, by: str = "zone_id", value: str = "value", probs=(0.1, 0.5), names=("p10_elev", "p50_elev")) -> DataFrame:
    """P10 and median elevation per zone, 0 for zones without valid cells."""
    valid = cells.where(F.col(value) > NODATA_BELOW)
    q = exact_percentiles(valid, value, probs, [by])
    columns = [F.col("q")[i].alias(n) for i, n in enumerate(names)]
    return zones.join(q.select(by, *columns), by, "left").withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})
