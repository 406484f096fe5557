"""Training-data operators: sharding, PII, LM scores, tokens, dedup, licences, search, quality, decontamination."""
