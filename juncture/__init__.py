"""Decision analytics on Spark: learn, evaluate and audit deterministic rule policies with DataFrames."""

__version__ = "0.1.0"
