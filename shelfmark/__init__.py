"""Retail analytics on PySpark: audit, clean, build the sales star, ask questions."""
