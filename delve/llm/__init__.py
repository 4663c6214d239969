"""Training-data operators: mixing, quality, secrets, WARC, deduplication, extraction, URL rules.

Nothing outside this folder imports it; :mod:`delve.llm.queries` registers its queries.
"""
