"""Meeting-transcript analytics as Spark DataFrame operators."""
