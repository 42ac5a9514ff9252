"""Importing this package registers all queries."""

from weftgraph.suite import datasets, graphs, inputs, logic, rewrites, texts  # noqa: F401
