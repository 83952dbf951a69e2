"""Training-data operators: crawl archives, text quality, language, fingerprints, packing, mixing.

Nothing outside this subpackage imports it. Every operator reads whole tables, keeps per-task memory
bounded by a batch (never by a group) and shares files only through the folder in spark.checkpoint.dir.
"""
