"""Operators that prepare text for the training of language models, and the pipeline's parts.

Nothing else in the library imports this folder.
"""
