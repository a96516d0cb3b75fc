"""Privacy analytics over tables: detection, grading and redaction of personal data as Spark queries."""
