"""Spark-native analytics over labelled 3-D raster volumes, held as voxel tables."""
