"""litlens: labelling document collections against closed vocabularies and
analysing the labels over time, as Spark DataFrame operators."""

__version__ = "0.1.0"
