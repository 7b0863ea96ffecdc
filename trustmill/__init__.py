"""Trustmill: audits and refines machine-learning training data on Apache Spark."""
