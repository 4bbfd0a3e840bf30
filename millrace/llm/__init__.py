"""Operators for training data: one module for each, and ``queries`` for the registered ones."""
