"""docloom: document analytics as Spark columns, table functions and grouped operators."""
