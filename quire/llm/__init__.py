"""Training-data operators: ten stand-alone DataFrame operators and the corpus pipeline."""
