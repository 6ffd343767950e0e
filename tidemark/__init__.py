"""Flood layers as Spark DataFrames: zones, panels, elevations and buildings."""
