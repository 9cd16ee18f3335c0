"""Fathomline: document retrieval, answer post-processing and request analytics as Spark plans."""
