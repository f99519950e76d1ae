"""Operators for preparing training text: one module per operator, the registered queries in `queries`."""
