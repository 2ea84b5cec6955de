"""Registered queries."""

from shardloom.plans import policies, registry, spills  # noqa: F401  the other two add their queries to the registry
