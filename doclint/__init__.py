"""doclint: corpus-scale résumé linting, scoring and job matching on PySpark DataFrames."""
