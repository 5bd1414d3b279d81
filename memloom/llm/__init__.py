"""Operators for training-data pipelines. Nothing else in memloom imports this subpackage."""
