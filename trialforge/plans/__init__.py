"""Importing this package registers all queries."""

from . import comparisons, files, labels, meshes, names, points, streams, trials, viewsets  # noqa: F401
