"""Operators on training text: token files, archives, filters, joins, packing."""
