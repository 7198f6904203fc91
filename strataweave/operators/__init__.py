"""Layers, metrics, signals and graph algorithms as DataFrame operators."""
