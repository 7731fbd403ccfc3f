"""Part of tessera; see README.md for the map of modules."""
