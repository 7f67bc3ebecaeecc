"""Rust source files to raw facts, and facts to a graph."""
