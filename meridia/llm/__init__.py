"""Operators for training data: entity links, representatives, leaks, residue and packing. Nothing else in the package imports this one."""
