"""turnweave: conversational data processing on PySpark.

Subpackages: ``sources`` (scans and sinks), ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``plans`` (whole dataflows and the query registry), ``streaming`` (Structured Streaming variants) and
``llm`` (operators for training data, optional: nothing else imports it).
"""

__version__ = "0.1.0"
