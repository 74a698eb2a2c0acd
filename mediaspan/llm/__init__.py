"""Training-data operators: near duplicates, decontamination, tokenizing, filters and audits."""
