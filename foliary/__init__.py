"""Foliary: document analytics on Spark."""
