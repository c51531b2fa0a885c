"""tidemark: debt analytics over DataFrames of metrics, call edges, coverage, history and text."""
