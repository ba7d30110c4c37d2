"""Operators for training corpora: deduplication, scans, tokens, decontamination, classifiers."""
