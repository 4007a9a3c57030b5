"""The review log as a stream. Reviews are appended with a sequence; readers see the latest of each subject."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def latest_status(reviews: DataFrame, subject: str = "subject", sequence: str = "sequence", status: str = "status") -> DataFrame:
    """The status of the highest sequence of each subject, for the update or complete mode; state is a row for each subject."""
    return reviews.groupBy(subject).agg(F.max(sequence).alias(sequence), F.max_by(status, sequence).alias(status))


def counted(reviews: DataFrame, at: str, kind: str, window: str, late: str) -> DataFrame:
    """Reviews by kind in tumbling windows; rows later than `late` behind the newest are dropped, and so is their state."""
    return reviews.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")


def once_each(reviews: DataFrame, ident: str, at: str, late: str) -> DataFrame:
    """Each review once, even if it is delivered again within `late`."""
    return reviews.withWatermark(at, late).dropDuplicatesWithinWatermark([ident])


DECIDED = "subject string, ordinal long, decision string, outcome string, status string"
_HELD = "following long, head string, status string, waiting string"


def decided(reviews: DataFrame) -> DataFrame:
    """DECIDED of a log of decisions (subject, ordinal, decision, expected, revision, supported): what each does to its subject's head.

    A subject's decisions are numbered from 0 and take effect in that order, however they arrive: one that comes early waits in
    the subject's state for those before it, one that comes twice counts once. A decision on another head than the current one is
    STALE; an approval without support is UNSUPPORTED, and one of what is rejected is REJECTED; others are accepted, set the status
    that they name and make their revision the head. State is the head, the status and what waits, of each subject; a hot subject's
    decisions of one batch are read in slices.
    """

    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, head, status, waiting = state.get if state.exists else (0, None, "pending_review", "{}")
        held = {int(k): v for k, v in json.loads(waiting).items()}
        for rows in batches:
            for ordinal, decision, expected, revision, supported in zip(*(rows[c] for c in ("ordinal", "decision", "expected", "revision", "supported")), strict=True):
                if ordinal >= following:
                    held.setdefault(int(ordinal), [decision, None if pd.isna(expected) else expected, revision, bool(supported)])
        out = []
        while following in held:
            decision, expected, revision, supported = held.pop(following)
            if expected != head:
                outcome = "STALE"
            elif decision == "approve" and not supported:
                outcome = "UNSUPPORTED"
            elif decision == "approve" and status == "rejected":
                outcome = "REJECTED"
            else:
                outcome, head = "accepted", revision
                status = {"approve": "verified", "reject": "rejected"}.get(decision, "pending_review")
            out.append((key[0], following, decision, outcome, status))
            following += 1
        state.update((following, head, status, json.dumps(held)))
        yield pd.DataFrame(out, columns=["subject", "ordinal", "decision", "outcome", "status"])

    rows = reviews.select(F.col("subject").cast("string").alias("subject"), F.col("ordinal").cast("long").alias("ordinal"), "decision", "expected", "revision", "supported")
    return rows.groupBy("subject").applyInPandasWithState(decide, DECIDED, _HELD, "append", "NoTimeout")
