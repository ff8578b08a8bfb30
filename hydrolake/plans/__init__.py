"""Pipelines built from the operators: feature tables, outlooks, training sets, models."""
