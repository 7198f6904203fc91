"""Layered dependency-graph analytics on Spark."""
