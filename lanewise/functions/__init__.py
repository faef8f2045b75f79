"""Column-level functions: no shuffles, no actions."""
