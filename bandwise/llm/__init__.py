"""Operators of a training-data pipeline: mixing, de-duplication, joins, classifiers, output files.

Nothing else in the library imports this subpackage; it may use the library's general helpers.
"""
