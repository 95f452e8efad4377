"""Part of the sunlattice engine."""
