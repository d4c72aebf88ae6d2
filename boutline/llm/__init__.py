"""Training-data operators: cleaning, dedup, decontamination, scoring, mixing."""
