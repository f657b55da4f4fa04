"""Nothing streams in this engine: voxel sets are bounded tables."""
