"""Operators for preparing training text, one module each, and their queries.

Nothing outside this package imports it. `queries.QUERIES` and `queries.ORACLES`
are what the entry module registers.
"""
