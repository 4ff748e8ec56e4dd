"""Spark-native analytics for particle trajectories, image-derived objects and their quality control."""
