"""Operators on voxel frames."""
