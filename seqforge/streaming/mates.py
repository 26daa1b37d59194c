"""Streaming counterparts: mates matched as they arrive, profiles that grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alignments import FIRST, SECOND, SECONDARY, has

_PAIR = "qname string, contig1 string, pos1 long, contig2 string, pos2 long"


def _matcher(wait_ms: int | None):
    def match(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Unmatched mates of a name are the state: [(first, contig, pos, mpos)]."""
        columns = ["qname", "contig1", "pos1", "contig2", "pos2"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        waiting = [tuple(r) for r in state.get[0]] if state.exists else []
        out = []
        for rows in batches:
            for r in rows.itertuples(index=False):
                one = (bool(r.first), r.contig, int(r.pos), int(r.mpos))
                other = next((w for w in waiting if w[0] != one[0] and w[2] == one[3] and w[3] == one[2]), None)
                if other is None:
                    waiting.append(one)
                    continue
                waiting.remove(other)
                a, b = (one, other) if one[0] else (other, one)
                out.append((key[0], a[1], a[2], b[1], b[2]))
        if waiting:
            state.update(([list(w) for w in waiting],))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    return match


def match_mates(stream: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """Pairs of primary mates (qname, flag, contig, pos, mpos) of a stream; a mate waits in the state until its other
    one comes. wait_ms: at most so long since its name was last seen; such a stream has batches without data too, in
    which states time out, so it wants a trigger with an interval."""
    rows = stream.where(~has(SECONDARY) & (has(FIRST) | has(SECOND))).select("qname", has(FIRST).alias("first"), F.col("contig").cast("string").alias("contig"), "pos", "mpos")
    state = "waiting array<struct<first:boolean,contig:string,pos:long,mpos:long>>"
    return rows.groupBy("qname").applyInPandasWithState(_matcher(wait_ms), _PAIR, state, "append", GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def position_quality(stream: DataFrame) -> DataFrame:
    """Counts and quality sums by position of a stream of reads (read_id, seq, qual); complete mode."""
    from ..operators.reads import bases

    return bases(stream).groupBy("pos").agg(F.count("*").alias("n"), F.sum("q").alias("sum_q"))


def windowed_counts(stream: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Rows by event-time window and key; rows later than late are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
