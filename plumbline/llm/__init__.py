"""Operators for preparing language-model training data.

Nothing outside this folder imports it; remove the folder and the rest of the
library still works.
"""
