"""The outlier model: preprocessing, isolation forest, storage."""
