"""newswake: event studies over news and daily prices, as PySpark DataFrames."""

__version__ = "0.1.0"
