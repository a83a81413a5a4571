"""Training-data operators: filters, near-duplicates, search, packing, tokenising.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only while the folder can be imported.
"""
