"""Whole runs put together from the operators: features, training, inference, reports."""
