"""Operators of a training-data pipeline (``corpus_pipeline.py`` strings five together).

Each module holds one operator with a general interface (DataFrame in,
DataFrame out) and its registered ``opN_*`` query. Spark partitions, shuffles
and stages the work; numpy kernels inside tasks do the byte-level parts.
Nothing outside this subpackage imports it, except the guarded registration in
``__spark_entry__.py`` and the pipeline module.
"""
