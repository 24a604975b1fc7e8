"""Operators over tables: index construction, suggestion, evaluation."""
