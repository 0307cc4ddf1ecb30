"""Column-level building blocks: no actions, no UDFs in the hot path."""
