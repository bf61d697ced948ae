"""pairloom: pairwise text and code similarity, evaluation and ensembles on PySpark."""

__version__ = "0.1.0"
