"""Similarity search whose matrices and deltas are built once: found in a catalog, or built and kept there.

A kept table is found by its name (path, place type, mode, distance, weights, grid) and by the rows that it
was made from, so a changed graph has tables of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from waymesh.functions.metapath import artefact_name
from waymesh.operators import matrix, similarity, spatial
from waymesh.operators.grid import HexCells, LatticeCells, grid_epsilon
from waymesh.sources.model import Graph

from .catalog import Catalog


class Search:
    """Top-k over a graph; *by* says how meta paths are written, *grid* which cells a resolution has (``lattice`` or ``hexagons``)."""

    def __init__(self, graph: Graph, catalog: Catalog, by: str = "edge_type", grid: str = "lattice"):
        if grid not in ("lattice", "hexagons"):
            raise ValueError("a grid is a lattice or hexagons")
        self.graph, self.catalog, self.by, self.grid = graph, catalog, by, grid

    def plain(self, path: str) -> DataFrame:
        """``i, j, v`` of a meta path."""
        return self.catalog.get_or_build(f"{self.by}|{path}", [self.graph.nodes, self.graph.edges], lambda: matrix.compose(self.graph, path, self.by))

    def matrix(self, path: str, place_type: str, eps_m: int, mode: str = "exact", weighted: bool = False, resolution: int | None = None) -> DataFrame:
        """``i, c, m``: the path relaxed at its end; *mode* is ``exact``, or ``under`` or ``over`` for the grid of a *resolution*."""
        return self.catalog.get_or_build(*self._named(path, place_type, eps_m, mode, weighted, resolution))

    def deltas(self, path: str, place_type: str, eps_m: int, mode: str = "exact", weighted: bool = False, resolution: int | None = None) -> DataFrame:
        """``i, delta`` of that matrix."""
        name, inputs, _ = self._named(path, place_type, eps_m, mode, weighted, resolution)
        return self.catalog.get_or_build(f"{name}|deltas", inputs, lambda: matrix.deltas(self.matrix(path, place_type, eps_m, mode, weighted, resolution)))

    def top_k(self, queries: DataFrame, k: int, path: str, place_type: str, eps_m: int, **more) -> DataFrame:
        """``query, node, score, rank`` of the best *k* for each query (``query``); *more* as for :meth:`matrix`."""
        what = (path, place_type, eps_m)
        return similarity.top_k_batch(self.matrix(*what, **more), queries, k, self.deltas(*what, **more))

    def _named(self, path: str, place_type: str, eps_m: int, mode: str, weighted: bool, resolution: int | None):
        at = self.graph.coordinates[place_type]

        def build() -> DataFrame:
            left = self.plain(path)
            if mode == "exact":
                return spatial.extend_exact(left, at, eps_m, weighted)
            cells = HexCells(resolution) if self.grid == "hexagons" else LatticeCells.of_resolution(resolution)
            return spatial.extend_grid(left, at, grid_epsilon(eps_m, cells.radius_m, mode), cells, weighted)

        if mode != "exact" and resolution is None:
            raise ValueError("a grid has a resolution")
        name = artefact_name(f"{self.by}|{path}", place_type, "exact" if mode == "exact" else "grid", eps_m, weighted, resolution)
        if mode != "exact" and self.grid == "hexagons":
            name += "|hexagons"
            if mode == "over" and HexCells(resolution).radius_m is None:
                raise ValueError("the covering radius is known for resolutions 5 to 9")
        return f"{name}|{mode}", [self.graph.nodes, self.graph.edges, at], build
