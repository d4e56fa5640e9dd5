"""Cells of a regular grid as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Rows count down from the top edge, columns right from the left edge; x0 and y0 are the lower left corner."""

    x0: float = 91000.0
    y0: float = 6124000.0
    cell: float = 1000.0
    rows: int = 1000
    cols: int = 1000

    @property
    def top(self) -> float:
        return self.y0 + self.rows * self.cell

    def shifted(self, dx: float, dy: float) -> Grid:
        """The same cells at another origin, as a file whose corner is off by dx and dy."""
        return replace(self, x0=self.x0 + dx, y0=self.y0 + dy)

    def tile(self, size: int, row: Column | str = "row", col: Column | str = "col") -> tuple[Column, Column]:
        """Row and column of the square of size x size cells that a cell lies in."""
        r, c = (F.col(v) if isinstance(v, str) else v for v in (row, col))
        return F.floor(r / size), F.floor(c / size)

    def row(self, y: Column | str) -> Column:
        return F.floor((F.lit(self.top) - (F.col(y) if isinstance(y, str) else y)) / F.lit(self.cell)).cast("bigint")

    def col(self, x: Column | str) -> Column:
        return F.floor(((F.col(x) if isinstance(x, str) else x) - F.lit(self.x0)) / F.lit(self.cell)).cast("bigint")

    def inside(self, row: Column | str = "row", col: Column | str = "col") -> Column:
        r, c = (F.col(v) if isinstance(v, str) else v for v in (row, col))
        return (r >= 0) & (r < self.rows) & (c >= 0) & (c < self.cols)

    def index(self, row: Column | str = "row", col: Column | str = "col") -> Column:
        r, c = (F.col(v) if isinstance(v, str) else v for v in (row, col))
        return r * self.cols + c

    def center_x(self, col: Column | str = "col") -> Column:
        return F.lit(self.x0) + F.lit(self.cell) * ((F.col(col) if isinstance(col, str) else col) + F.lit(0.5))

    def center_y(self, row: Column | str = "row") -> Column:
        return F.lit(self.top) - F.lit(self.cell) * ((F.col(row) if isinstance(row, str) else row) + F.lit(0.5))


#: The study grid, 1000 by 1000 cells of one kilometre.
STUDY = Grid()
