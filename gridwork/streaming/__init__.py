"""Incremental runs of the Column-level functions over a file stream.

The lessons have no streams. What carries over is that every helper in
``gridwork.functions`` is a plain Spark expression, so the same text, regex
and JSON cleaning runs unchanged on a Structured Streaming source. Progress
(which files are done) lives in a checkpoint under the session's shared
``spark.checkpoint.dir``, so a restarted or failed run resumes where it
stopped.
"""

from gridwork.streaming.incremental import read_stream, run_available_now, text_profile_stream

__all__ = ["read_stream", "run_available_now", "text_profile_stream"]
