"""Bounded integer grids as column expressions: L1 distance, neighbourhoods, nearest cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def l1(x1, y1, x2, y2) -> Column:
    return F.abs(col(x1) - col(x2)) + F.abs(col(y1) - col(y2))


def clamp(value, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(value)))


def cell(x, y) -> Column:
    return F.struct(col(x).cast("int").alias("x"), col(y).cast("int").alias("y"))


def in_bounds(c: Column, width: int, height: int) -> Column:
    return c["x"].between(0, width - 1) & c["y"].between(0, height - 1)


def neighbours(x, y, width: int, height: int) -> Column:
    """West, east, north and south cells inside the grid, in that order."""
    x, y = col(x), col(y)
    around = F.array(cell(x - 1, y), cell(x + 1, y), cell(x, y - 1), cell(x, y + 1))
    return F.filter(around, lambda c: in_bounds(c, width, height))


def ball(x, y, radius: int, width: int, height: int) -> Column:
    """All cells within L1 distance ``radius`` inside the grid, by x then y."""
    x, y = col(x), col(y)
    steps = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(abs(dx) - radius, radius - abs(dx) + 1)]
    return F.filter(F.array(*[cell(x + dx, y + dy) for dx, dy in steps]), lambda c: in_bounds(c, width, height))


def nearest(cells: Column, x, y) -> Column:
    """Struct (distance, x, y) of the cell nearest to a point; ties by cell."""
    x, y = col(x), col(y)
    return F.array_min(F.transform(cells, lambda c: F.struct((F.abs(c["x"] - x) + F.abs(c["y"] - y)).alias("distance"), c["x"].alias("x"), c["y"].alias("y"))))


def next_step(open_cells: Column, gx, gy, occupied: Column, visited: Column) -> Column:
    """The open cell to take towards a target: least (distance, distance of the best cell after it, visited, cell); null without any."""
    gx, gy = col(gx), col(gy)
    away = lambda c: F.abs(c["x"] - gx) + F.abs(c["y"] - gy)
    is_in = lambda cells, c: F.exists(cells, lambda o: (o["x"] == c["x"]) & (o["y"] == c["y"]))

    def score(c):
        after = F.array(cell(c["x"] - 1, c["y"]), cell(c["x"] + 1, c["y"]), cell(c["x"], c["y"] - 1), cell(c["x"], c["y"] + 1))
        after = F.filter(after, lambda a: (a["x"] >= 0) & (a["y"] >= 0) & ~is_in(occupied, a))
        later = F.coalesce(F.array_min(F.transform(after, away)), F.lit(1_000_000_000))
        return F.struct(away(c).alias("distance"), later.alias("later"), is_in(visited, c).cast("int").alias("seen"), c["x"].alias("x"), c["y"].alias("y"))

    return F.array_min(F.transform(open_cells, score))
