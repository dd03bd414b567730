"""The three end-to-end jobs: annotate, merge, analyze."""
