"""Evaluation, attribution and corpus operators as DataFrame -> DataFrame transformations on Spark."""
