"""Operators that prepare corpora for language-model training.

Nothing outside this subpackage imports it; ``queries.py`` holds the ``opN_``
entry points and ``oracles.py`` their SQL counterparts.
"""
