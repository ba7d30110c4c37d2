"""Whole flows built from the operators: training, an anomaly run, review and report."""
