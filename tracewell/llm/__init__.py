"""Training-data operators: toxicity, nearest neighbours, token files, chat formatting, decontamination, WARC, HTML extraction, SimHash, language ID, packing."""
