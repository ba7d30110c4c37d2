"""Where frames come from and where results are kept."""
