"""Operators for preparing training text at scale: mixing, quality rules, URL
filters, similarity joins, nearest neighbours, WARC, packing, sharding, token
counts and repeated-passage removal. Nothing else in the library imports this
subpackage."""
