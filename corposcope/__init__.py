"""Spark-native ranked search and structural analysis over large text collections."""
__version__ = "0.1.0"
