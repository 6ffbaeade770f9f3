"""Tests of the corpus operators (a package, so its conftest has a name of its own)."""
