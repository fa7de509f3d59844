"""Contextual retrieval, evaluation and corpus preparation as Spark DataFrame plans."""
