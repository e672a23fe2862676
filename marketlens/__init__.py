"""marketlens: prediction-market analytics as lazy PySpark DataFrame functions."""

__version__ = "0.1.0"
