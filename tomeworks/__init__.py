"""Knowledge-base data work as Spark DataFrames: documents to chunks, retrieval,
grounded sample sets, their validation and evaluation, answer traces and bad-case mining."""

__version__ = "0.1.0"
