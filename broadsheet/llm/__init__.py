"""Training-data operators. Nothing outside this folder imports it, apart from the guarded hook of ``__spark_entry__``."""
