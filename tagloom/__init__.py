"""Label-score analytics on Spark: scores, prompts, generation metadata, catalogs, tensors."""

__version__ = "0.1.0"
