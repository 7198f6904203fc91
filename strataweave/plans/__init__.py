"""Builds, stored graphs, fixed queries and exports."""
