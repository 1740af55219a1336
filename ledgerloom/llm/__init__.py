"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Its queries and their SQL are in
:mod:`ledgerloom.llm.queries`.
"""
