"""Training-data operators: filters, scorers, joins and codecs for large text corpora.

Nothing outside this subpackage imports it.
"""
