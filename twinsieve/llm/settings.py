"""Parameters of operators that have several."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Graph:
    """A small-world graph: ``degree`` links a node on upper layers and twice as many on the lowest.

    shard, shard_bytes: most nodes of a graph, about, and most bytes of their vectors.
    block: most queries of a cell. cells: of a task, where there are many. width: the
    beam at first. slack: how far below the threshold a search goes on at first.
    audited: queries of each cell that are answered by brute force at a time, until
    these have ``tested`` links with other nodes.
    """

    degree: int = 12
    build_width: int = 48
    width: int = 32
    slack: float = 0.05
    shard: int = 16384
    shard_bytes: int = 64 << 20
    block: int = 2048
    cells: int = 16
    audited: int = 32
    tested: int = 512
