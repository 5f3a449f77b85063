"""Boosting, round estimation and whole runs."""
