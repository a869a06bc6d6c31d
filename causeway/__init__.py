"""Causeway: point-in-time features, entity-graph fields and their evaluation, on Spark."""
