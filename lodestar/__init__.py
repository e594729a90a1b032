"""lodestar: DataFrame-first analytics over collections of labelled vectors, their catalogues and text corpora."""

__version__ = "0.1.0"
