"""Lectern: Spark jobs that prepare written text for speech, and text corpora for training."""
