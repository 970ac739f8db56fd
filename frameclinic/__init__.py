"""Data-quality stress tests and repairs for Spark DataFrames.

Damage a clean table in a controlled way, repair it with fit/transform cleaning
recipes, score the repairs with leak-free cross-validation, and summarise how
much quality each recipe recovers.
"""
