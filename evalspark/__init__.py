"""Evaluation of text classifiers on Spark: annotate, merge, measure, explain the errors."""
