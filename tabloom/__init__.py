"""tabloom: automatic analysis of unfamiliar tabular folders, expressed as Spark DataFrames."""

__version__ = "0.1.0"
