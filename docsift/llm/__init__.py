"""Operators for training-data pipelines: detection, filtering, deduplication,
mixing, formatting and tokenization of document tables.

Nothing outside this subpackage (but ``corpus_pipeline.py`` and the guarded
import in ``__spark_entry__.py``) imports it.
"""
