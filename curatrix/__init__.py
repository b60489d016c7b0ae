"""Record curation, scoring and shortlisting as DataFrame operators on Spark."""
