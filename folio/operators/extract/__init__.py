"""Readers: bytes of a file to text. Pure functions, run inside Arrow batches."""
