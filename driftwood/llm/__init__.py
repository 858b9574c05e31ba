"""Operators for preparing language-model training corpora.

Each module holds one operator with a general interface; ``queries.py`` holds the thin
``opN_<name>`` queries over the driver's tables.  Nothing outside this folder imports it.
"""
