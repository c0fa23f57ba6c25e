"""Column -> Column helpers built only from Spark built-in expressions, so
they stay inside whole-stage codegen and work on batch and streaming frames
alike. Where Python/NumPy/pandas semantics differ from Spark's, the Python
rule is implemented and stated."""
