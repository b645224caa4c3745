"""Training-data operators: decontamination, WARC, dedup, language, quality, licences, BPE, toxicity."""
