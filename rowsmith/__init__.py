"""rowsmith: messy delimited text in and out of Spark DataFrames."""

from rowsmith.operators.writer import Writer, generate, to_csv_string, write
from rowsmith.sources.reader import CsvReader, last_errors, last_warnings, parse, parse_column, parse_documents, read
from rowsmith.streaming.stream import import_chunks, read_stream

__all__ = ["CsvReader", "Writer", "generate", "import_chunks", "last_errors", "last_warnings", "parse", "parse_column", "parse_documents", "read", "read_stream", "to_csv_string", "write"]
