"""Training-data operators: dedup, filtering, packing, mixing, retrieval.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
