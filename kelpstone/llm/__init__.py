"""Operators for preparing training text at corpus scale.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
