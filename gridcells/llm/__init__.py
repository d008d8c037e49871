"""Operators for preparing large training corpora, one module per operator.

Nothing outside this folder imports it.  ``queries.py`` registers one query per operator.
"""
