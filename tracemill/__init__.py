"""Curation of reasoning traces and of training text as Spark DataFrame plans."""
