"""Training-data operators: near-duplicates, language, decontamination, packing,
token stores, toxicity, sharding, sketches, page text and chat templates.

Nothing outside this subpackage imports it.
"""
