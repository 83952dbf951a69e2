"""Quantum-error-correction syndrome data as DataFrames: lattices, noise, decoding, verification, statistics."""
