"""Spatial joins as equi-joins on grid cells.

A row with an extent is copied to every cell it touches (plus the join's reach); the join key is
(scope columns, cell), so work spreads over cells and not over images. A pair that meets in several
cells is kept only in the cell of its reference point, which replaces a ``distinct`` over pairs.
Skewed cells are split at run time by adaptive skew join; ``salts`` spreads every cell further when
the caller knows of hot cells: the left side is hashed over the salts, the right side copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CELL = 256.0


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def explode_cells(df: DataFrame, xmin, ymin, xmax, ymax, cell: float = CELL, reach: float = 0.0) -> DataFrame:
    """One row per touched cell, as columns ``cx`` and ``cy``."""
    cx = F.sequence(_cell(xmin - reach, cell), _cell(xmax + reach, cell))
    cy = F.sequence(_cell(ymin - reach, cell), _cell(ymax + reach, cell))
    return df.withColumn("cx", F.explode(cx)).withColumn("cy", F.explode(cy))


def point_cells(df: DataFrame, x, y, cell: float = CELL) -> DataFrame:
    return df.withColumn("cx", _cell(x, cell)).withColumn("cy", _cell(y, cell))


def _salted(left: DataFrame, right: DataFrame, salts: int) -> tuple[DataFrame, DataFrame, list[str]]:
    if salts <= 1:
        return left, right, []
    left = left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left, right, ["salt"]


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def overlapping_boxes(
    left: DataFrame,
    right: DataFrame,
    scope: list[str],
    *,
    once: Column | None = None,
    strict: bool = False,
    cell: float = CELL,
    salts: int = 1,
) -> DataFrame:
    """Pairs whose boxes (column ``bb``) meet inside the same scope, each pair once.

    Columns come back as ``a_*`` and ``b_*``. ``once`` is an extra pair predicate, such as an id
    order for self joins. ``strict`` drops boxes that only touch.
    """

    def spread(df, prefix):
        bb = F.col("bb")
        df = explode_cells(df, bb["xmin"], bb["ymin"], bb["xmax"], bb["ymax"], cell)
        return prefixed(df, prefix, [*scope, "cx", "cy"])

    a, b, extra = _salted(spread(left, "a_"), spread(right, "b_"), salts)
    pairs = a.join(b, [*scope, "cx", "cy", *extra])
    aa, bb = F.col("a_bb"), F.col("b_bb")
    if strict:
        meets = (aa["xmin"] < bb["xmax"]) & (bb["xmin"] < aa["xmax"]) & (aa["ymin"] < bb["ymax"]) & (bb["ymin"] < aa["ymax"])
    else:
        meets = (aa["xmin"] <= bb["xmax"]) & (bb["xmin"] <= aa["xmax"]) & (aa["ymin"] <= bb["ymax"]) & (bb["ymin"] <= aa["ymax"])
    reference = (_cell(F.greatest(aa["xmin"], bb["xmin"]), cell) == F.col("cx")) & (
        _cell(F.greatest(aa["ymin"], bb["ymin"]), cell) == F.col("cy")
    )
    condition = meets & reference
    if once is not None:
        condition = condition & once
    return pairs.where(condition).drop("cx", "cy", *extra)


def near(
    points: DataFrame,
    targets: DataFrame,
    scope: list[str],
    condition: Column,
    *,
    reach: float,
    how: str = "inner",
    cell: float | None = None,
) -> DataFrame:
    """Join points (columns ``px``, ``py``) with targets (column ``bb``) closer than ``reach``.

    The targets are copied to every cell within reach and a point stays in its own cell, so a pair
    meets exactly once and the semi and anti forms need no clean-up.
    """
    cell = cell or max(4 * reach, 64.0)
    bb = F.col("bb")
    if how in ("left_semi", "left_anti"):
        # copies of a target cannot change whether one is near, so they are folded before the copying
        targets = targets.distinct()
    t = explode_cells(targets, bb["xmin"], bb["ymin"], bb["xmax"], bb["ymax"], cell, reach)
    edges = ("xmin", "ymin", "xmax", "ymax")
    t = t.withColumns({f"t_{e}": bb[e] for e in edges}).drop("bb")
    p = point_cells(points, F.col("px"), F.col("py"), cell)
    keys = [*scope, "cx", "cy"]
    t = t.select(*[F.col(c).alias(f"t_{c}") for c in keys], *[c for c in t.columns if c not in keys])
    # a cheap box test spares most of the exact tests within a cell
    px, py = F.col("px"), F.col("py")
    boxed = (px >= F.col("t_xmin") - reach) & (px <= F.col("t_xmax") + reach) & (py >= F.col("t_ymin") - reach) & (py <= F.col("t_ymax") + reach)
    on = boxed & condition
    for k in keys:
        on = (F.col(k) == F.col(f"t_{k}")) & on
    joined = p.join(t, on, how)
    return joined.drop("cx", "cy", *[f"t_{k}" for k in (*keys, *edges)])


def segments(df: DataFrame, path: str = "pts") -> DataFrame:
    """One row per edge of ``path`` with its box; the path column is dropped before the explode."""
    from cadastre.functions.geom import indexed_edges

    others = [c for c in df.columns if c != path]
    e = df.select(*others, F.explode(indexed_edges(F.col(path))).alias("e"))
    e = e.select(*others, F.col("e.seq").alias("seg"), *[F.col(f"e.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return e.withColumn(
        "bb",
        F.struct(
            F.least("x1", "x2").alias("xmin"),
            F.least("y1", "y2").alias("ymin"),
            F.greatest("x1", "x2").alias("xmax"),
            F.greatest("y1", "y2").alias("ymax"),
        ),
    )


def vertices(df: DataFrame, path: str = "pts", start: int = 0) -> DataFrame:
    """One row per vertex as ``seq``, ``px``, ``py``."""
    others = [c for c in df.columns if c != path]
    v = df.select(*others, F.posexplode(F.col(path)).alias("seq", "p"))
    return v.select(*others, (F.col("seq") + start).alias("seq"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))
