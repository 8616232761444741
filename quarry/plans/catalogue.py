"""Collects the registries of every plan module."""

from __future__ import annotations

from quarry.plans import flows, graphs, multimodel, relational, scalars, searches, temporal
from quarry.registry import Registry

REGISTRY = Registry()
for _module in (relational, temporal, scalars, graphs, searches, flows, multimodel):
    for _name, _fn in _module.R.queries.items():
        REGISTRY.add(_name, _module.R.oracles.get(_name))(_fn)
