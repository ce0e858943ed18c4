"""dagloom: analytics over corpora of shared expression graphs, on Spark."""

__version__ = "0.1.0"
