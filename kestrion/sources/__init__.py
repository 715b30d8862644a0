"""Sources: driver tables, repository walks, shared scratch space."""
