"""Operators for preparing training text: scans, deduplication, filtering, mixing, token files and chat repair."""
