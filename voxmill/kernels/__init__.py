"""NumPy kernels for the steps that are sequential by nature, one connected component at a time."""
