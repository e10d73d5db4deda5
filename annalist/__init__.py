"""Annalist: Spark operators for records that change over time."""
