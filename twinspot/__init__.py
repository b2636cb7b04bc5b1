"""Screening of figures and corpora for reuse, as Spark DataFrame stages."""
