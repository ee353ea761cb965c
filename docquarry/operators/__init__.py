"""What is done with documents: admission, ingest, postings, matching, search, reports."""
