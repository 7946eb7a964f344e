"""cordwood: log analytics and log-shaped data processing expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
