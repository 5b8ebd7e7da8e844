"""voxloom: a Spark-native engine for conversational and speech-model training data.

Sub-packages
------------
functions   column expressions (text, chat, lengths, audio headers, number spelling)
operators   DataFrame -> DataFrame operators (filters, windows, batching, sampling, joins, metrics)
sources     readers and writers (tar shards, JSONL, TSV, manifests, parquet corpora)
plans       configuration objects, checks and multi-step pipelines
streaming   Structured Streaming versions of the record pipeline
llm         training-data operators; optional, nothing else imports it
"""

__version__ = "0.1.0"
