"""Declarative plans: cleaning specs, synthetic domains and the task suite."""
