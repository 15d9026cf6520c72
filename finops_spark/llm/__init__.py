"""Operators for preparing training text: one module each, plus the pipeline's queries."""
