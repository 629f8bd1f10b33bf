"""Sources (readers) and sinks (writers) for corpora and token streams."""
