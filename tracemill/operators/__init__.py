"""Operators over traces, arms and evaluation results."""
