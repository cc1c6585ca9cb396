"""Operators for building training data at scale; nothing outside this folder imports it."""
