"""Whole plans: matching, the pipeline, and the registered queries."""
