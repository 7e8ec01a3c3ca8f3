"""Training-data operators: sharding, packing, near-duplicate search, WARC, chat, quality, BPE, language, lines, embeddings.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
