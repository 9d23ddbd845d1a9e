"""Table profiling, model selection and method comparison on Spark."""
