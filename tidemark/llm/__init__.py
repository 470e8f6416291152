"""Operators that prepare text corpora for language-model training.

Nothing outside this package imports it; the package itself imports nothing from the rest of the library, but for the query of the pipeline, which runs the module at the top.
"""
