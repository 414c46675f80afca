"""Folio: document and semi-structured analytics on PySpark."""
