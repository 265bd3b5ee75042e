"""Fact layer on Spark: claims, keys, grounding and reconciliation as DataFrame plans."""
