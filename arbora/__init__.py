"""Spark-native analytics for airborne and footprint lidar point clouds."""
