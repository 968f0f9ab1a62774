"""Training-data operators over corpora; nothing else in the package imports these."""
