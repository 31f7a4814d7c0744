"""Corpus operators for language-model training data.

Nothing outside this folder imports it; the driver entry adds its queries only
where the folder is present.
"""
