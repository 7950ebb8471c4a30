"""Training-data operators. Nothing outside this subpackage and
``corpus_pipeline.py`` imports it, so the folder can be removed whole."""
