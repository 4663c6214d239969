"""Exact, index-accelerated regular-expression search over stored objects, as DataFrame plans."""
