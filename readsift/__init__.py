"""readsift: register-read exception analytics on Spark.

The package turns warehouse tables of meter register reads into one labelled row
per validation exception, and carries that frame through folds, encoding,
learners and evaluation. Every operator takes and returns Spark DataFrames.
"""
