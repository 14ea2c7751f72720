"""Session-usage analytics on Spark: transcripts in, priced and attributed grains out.

``sources``    readers and writers (transcript lines, price tables, partitioned corpus)
``functions``  column expressions (strict variant access, record fields, formats, images)
``operators``  DataFrame operators, each taking frames and column names
``plans``      the mine job, the export job and the bindings used by ``__spark_entry__``
"""

from ledgerline.session import build_session, configure

__all__ = ["build_session", "configure"]
