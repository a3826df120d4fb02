"""Training-data operators: fingerprints, packing, filters, near-duplicates, tokenizing, labelling.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` are in
``gridfront.llm.queries``.
"""
