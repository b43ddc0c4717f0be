"""Training-data operators: packing, PII, quality, LM scoring, token counts, mixing,
fingerprints, HTML extraction, chat formatting, the n-gram Jaccard join, SimHash near-duplicates,
whitening and tokenizer alignment.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query per operator.
"""
