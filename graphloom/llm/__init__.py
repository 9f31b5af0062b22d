"""Training-data operators: licences, duplicates, tokens, URLs, languages, benchmarks, HTML, mixing, personal data."""
