"""Column-level functions: no shuffles, no Python in the data path unless stated."""
