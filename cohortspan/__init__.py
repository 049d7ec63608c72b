"""Retrospective cohort analytics expressed as Spark DataFrame transformations."""
