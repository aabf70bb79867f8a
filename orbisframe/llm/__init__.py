"""Training-data pipeline operators (license, dedup, WARC, HTML, chat, packing, PII, language, decontamination)."""
