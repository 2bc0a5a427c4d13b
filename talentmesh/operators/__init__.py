"""DataFrame operators: profile extraction, embedding, scoring, ranking, sinks."""
