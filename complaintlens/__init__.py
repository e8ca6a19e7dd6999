"""Complaint-text analytics and exact vector retrieval as Spark jobs.

Every operator is a function from DataFrame to DataFrame with the column names
as parameters; see the sub-packages:

* ``sources``    readers, writers, column resolution
* ``functions``  Column expressions (text, vectors, display)
* ``operators``  DataFrame operators (cleaning, profile, dashboard, sampling,
  chunking, embedding, retrieval, prompts, evaluation)
* ``streaming``  incremental vector ingest
* ``plans``      end-to-end jobs, registered queries and their SQL counterparts
"""

__version__ = "0.1.0"
