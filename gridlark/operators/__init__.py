"""Operators over fields: DataFrames of (point_id, x, y, z, m, value)."""
