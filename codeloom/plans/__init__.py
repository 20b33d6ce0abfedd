"""Plan-level tools: lineage cuts and scratch tables."""
