"""Operators of a training-data pipeline: language, quality, duplicates, fingerprints, mixing and packing.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered queries and their SQL.
Every operator takes a DataFrame of documents (``doc_id``, ``text`` and, where named, ``lang`` and ``source``),
reads only the columns it names, and ignores all others, whatever they are called.
"""
