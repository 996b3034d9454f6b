"""Relational and model operators (prepare, profile, detectors, evaluation, reports)."""
