"""Readers and writers of texts. Files are read by Spark's readers, so any store that Spark reaches will do."""

from lafzspark.sources.texts import decoded_lines, read_documents, read_lexicon, read_lines, write_json_lines, write_lines

__all__ = ["decoded_lines", "read_documents", "read_lexicon", "read_lines", "write_json_lines", "write_lines"]
