"""Operators: detectors, overlap resolution, rules, masking, restoring, metrics."""
