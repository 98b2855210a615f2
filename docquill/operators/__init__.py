"""Query operators over DataFrames: filters, find, pipelines, updates, search."""
