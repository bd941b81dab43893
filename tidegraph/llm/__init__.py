"""Training-data operators: filters, extraction, matching, packing and storage for text corpora.

Nothing outside this subpackage imports it.  ``tidegraph.llm.catalog`` lists its
queries for the driver contract.
"""
