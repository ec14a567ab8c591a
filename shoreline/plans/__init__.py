"""Pipelines: generic site reports, the beach reports, lookup, and the
queries registered for the driver's tables."""
