"""DataFrame operators; each takes and returns plain DataFrames."""
