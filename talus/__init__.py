"""Talus: PySpark operators for retrieval corpora, verification and evaluation."""
