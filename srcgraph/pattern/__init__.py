"""A read-only graph-pattern query language, compiled to DataFrame plans."""

from srcgraph.pattern.planner import run  # noqa: F401
