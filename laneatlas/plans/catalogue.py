"""Every registered query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from laneatlas.plans import geography, imagery, learning, markings, raster, traffic, windows

_ALL = {**geography.QUERIES, **traffic.QUERIES, **markings.QUERIES, **raster.QUERIES, **imagery.QUERIES, **learning.QUERIES, **windows.QUERIES}

QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
