"""Operators for preparing training corpora.

Nothing outside this folder imports it; delete it and the rest of the
library still works.
"""
