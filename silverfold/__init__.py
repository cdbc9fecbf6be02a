"""silverfold: a PySpark-native analytics engine for media catalogues."""

__version__ = "0.1.0"
