"""Operators for building language-model training data.

Nothing outside this folder imports it; the entry module adds its queries only
when the folder is present.
"""
