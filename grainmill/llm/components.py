"""Connected components of an edge table, as the operators have them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from grainmill.operators import components
from grainmill.operators.components import forest

__all__ = ["ONE_TASK", "connected_components", "forest"]

#: So many edges at most (counted first) are connected in one task.
ONE_TASK = components.ONE_TASK


def connected_components(edges: DataFrame, stars: bool = False) -> DataFrame:
    """node, root: for each node of edges (a, b), the smallest node that it is connected to. Null ends are dropped. stars: edges come from `forest`."""
    return components.connected_components(edges, ONE_TASK, stars)
