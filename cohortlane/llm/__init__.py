"""Training-data operators: formatting, filtering, matching, scanning, scoring and packing of text corpora."""
