"""The column functions on streams."""

from lafzspark.streaming.texts import event_counts, normalized, read_stream, word_counts

__all__ = ["event_counts", "normalized", "read_stream", "word_counts"]
