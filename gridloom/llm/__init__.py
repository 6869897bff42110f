"""Training-data operators: ten stand-alone DataFrame operators for text corpora."""
