"""Options of the branch analysis, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Options:
    """Defaults are those of the analysis; sigma has none.

    ``nodes_for(n)`` applies the size rules: ten rows a node at least, else floor(n / 100) * 10
    nodes, and no fewer than twenty.
    """

    sigma: float
    metric: str = "L1"
    outlier: float = 0.01
    threshold: float = 0.5
    sample_size: int = 100_000
    n_ref_cells: int = 200
    n_dens_ref: int = 5_000
    n_trees: int = 1_000
    seed: int = 73
    layout_seed: int | None = None
    layout_graph: int | None = 6
    p_cutoff: float = 0.95
    three_branches: bool = False
    zero_ball: bool = False
    knn_density: bool = False
    cofactors: dict[str, float] = field(default_factory=dict)
    default_cofactor: float = 5.0
    min_branch_rows: int = 200
    min_nodes: int = 20

    def __post_init__(self):
        if self.metric not in ("L1", "L2", "angle"):
            raise ValueError(f"metric {self.metric!r} is none of L1, L2, angle")
        if not self.sigma > 0:
            raise ValueError("sigma must be positive")
        for name in ("outlier", "threshold", "p_cutoff"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        for name in ("sample_size", "n_ref_cells", "n_dens_ref", "n_trees"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.layout_graph is not None and self.layout_graph not in range(1, 7):
            raise ValueError("layout_graph must be 1 .. 6, or None for all six")

    def nodes_for(self, rows: int) -> int:
        n = self.n_ref_cells if rows >= 10 * self.n_ref_cells else rows // 100 * 10
        if n < self.min_nodes:
            raise ValueError(f"{rows} rows are too few: {n} nodes, {self.min_nodes} needed")
        return n

    def with_(self, **changes) -> Options:
        return replace(self, **changes)
