"""laneatlas: a PySpark-native engine for map tiles, road rasters, detections and traffic heatmaps."""

__version__ = "0.1.0"
