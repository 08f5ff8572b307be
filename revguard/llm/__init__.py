"""Operators for preparing training text: thirteen Spark jobs over documents, pages and vectors.

Nothing outside this folder imports it; the driver entry adds its queries when
the folder is there.
"""
