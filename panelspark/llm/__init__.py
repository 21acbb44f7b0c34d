"""Training-data operators: near-duplicates, tokenizers, media, URL rules, records, classifiers, language models, PII."""
