"""Operations of a large-scale training-data pipeline, one module each.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
