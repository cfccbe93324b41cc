"""Plan helpers: shared intermediate tables, components of link tables."""
