"""Operators over DataFrames: schema, profile, clean, eda, charts, prep,
metrics, models, explain, results."""
