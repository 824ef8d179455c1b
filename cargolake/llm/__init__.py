"""Training-data operators: scans, counts, deduplication, packing, extraction,
classification, language-model scoring, decontamination and vector search.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` binds them to the given tables.
"""
