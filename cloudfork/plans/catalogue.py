"""All registered queries of the core and their SQL."""

from __future__ import annotations

from cloudfork.plans import basics, distances, drift, graphs, information, views
from cloudfork.plans.distances import nearest_centroid_nmi  # noqa: F401

_MODULES = (basics, information, distances, graphs, views, drift)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
