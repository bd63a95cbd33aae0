"""Masking of streams.  Masks are pure expressions, so a stream is masked by the same projection as a
table; what needs the vault is done batch by batch, in the order: assign, write the vault, emit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import Keys
from ..operators import text
from ..operators.vault_table import VaultTable
from ..plans import jobs


def mask_stream(stream: DataFrame, keys: Keys, o: text.Options = text.Options(), column: str = "text") -> DataFrame:
    """The stream with unsalted tokens and no vault; ``start`` masks what is to be restored."""
    return text.mask_text(stream, keys, o, column)


def start(stream: DataFrame, keys: Keys, vault_path: str, emit: Callable[[DataFrame, int], None], checkpoint: str, o: text.Options = text.Options(), column: str = "text") -> StreamingQuery:
    """Runs the stream; each batch's new values are committed to the vault table before it is emitted, whoever else writes to it.
    Assignment is keyed by value, so a repeated batch adds nothing."""

    table = VaultTable(stream.sparkSession, vault_path)

    def batch(df: DataFrame, n: int) -> None:
        masked, _ = jobs.mask_into(df, keys, table, o, column)
        emit(masked, n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, keys: Keys, time: str = "ts", user: str = "user_id", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events per masked user and window, on a stream or a table."""
    from ..functions import tokens

    name = tokens.token(keys, "user", F.col(user).cast("string")).alias("user_token")
    return events.withWatermark(time, late).groupBy(F.window(time, window), name).agg(F.count("*").alias("n_events"))
