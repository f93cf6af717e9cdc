"""Preparation of text corpora for training: one module for each operator, and their queries."""
