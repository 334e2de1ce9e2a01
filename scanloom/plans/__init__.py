"""Pipelines: the stack language and the registered queries."""
