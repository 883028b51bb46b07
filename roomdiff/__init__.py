"""Versioned 3D scans of rooms as Spark tables: align, compare, track, publish, ask."""
