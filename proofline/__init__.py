"""Proofline: text-evidence validation and corpus processing as Spark DataFrame plans."""

__version__ = "0.1.0"
