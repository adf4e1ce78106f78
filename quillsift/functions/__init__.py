"""Column functions: text analysis, scoring and scalars.  All run on the JVM but the dictionary segmenter."""
