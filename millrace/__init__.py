"""millrace: batch analytics on Spark, declared as DataFrame plans."""

__version__ = "0.1.0"
