"""The registered queries, by subject; importing this package registers them."""

from . import metric_queries, queue_queries, sampling_queries, source_queries, stream_queries, text_queries  # noqa: F401
