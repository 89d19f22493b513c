"""T4: the after-insert trigger on signups as a stream of upserts.

The usage table is kept in hash buckets of the user with a commit log
(``sinks.bucketed``). A micro-batch rewrites the buckets its signups fall into
by the signup upsert (D10); others are not touched. Readers open the folders
that the newest manifest names, however many micro-batches came before. A
writer that dies before its commit leaves files that nobody reads; the replayed
micro-batch replaces them, and one that was committed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from quillspark.operators.usage import signup_upsert
from quillspark.sinks.bucketed import BucketTable, stored

STREAM = "signups"


def signup_batch_writer(table: BucketTable, admins: DataFrame, testers: DataFrame, as_of: Column):
    def apply(batch: DataFrame, batch_id: int) -> None:
        if table.done(STREAM, batch_id):
            return
        signups = stored(batch.select("id", "email"), f"signups_{batch_id}")
        table.update(lambda rows: signup_upsert(rows, signups, admins, testers, as_of), signups, "id", STREAM, batch_id)
    return apply
