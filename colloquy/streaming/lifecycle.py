"""The lifecycle of sessions: which status may follow which, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every status and those that may follow it.
NEXT = {
    "uploaded": ["recorded", "failed"],
    "recorded": ["transcribing", "failed"],
    "transcribing": ["transcribed", "failed"],
    "transcribed": ["refining", "identifying_speakers", "failed"],
    "refining": ["refined", "failed"],
    "refined": ["identifying_speakers", "failed"],
    "identifying_speakers": ["speakers_identified", "speaker_pending", "failed"],
    "speakers_identified": ["attributing", "summarizing", "speaker_pending", "failed"],
    "speaker_pending": ["speakers_identified", "attributing", "failed"],
    "attributing": ["attribution_ready", "attribution_review", "failed"],
    "attribution_ready": ["attribution_review", "summarizing", "attributing", "failed"],
    "attribution_review": ["attributing", "summarizing", "failed"],
    "summarizing": ["summary_ready", "failed"],
    "summary_ready": ["generating_wiki", "summarizing", "attributing", "failed"],
    "generating_wiki": ["wiki_plan_ready", "failed"],
    "wiki_plan_ready": ["applying_wiki", "attributing", "failed"],
    "applying_wiki": ["content_ready", "failed"],
    "content_ready": ["reviewed", "failed"],
    "reviewed": ["published", "content_ready", "failed"],
    "published": ["reviewed", "failed"],
    "failed": ["attributing", "summarizing", "generating_wiki", "applying_wiki"],
}
#: Statuses that may be entered again, by a job that is delivered twice.
REPEATABLE = "transcribing refining identifying_speakers attributing summarizing generating_wiki applying_wiki".split()
KEPT = "applying_wiki content_ready reviewed published".split()
STATUSES = list(NEXT)
FIRST = "uploaded"
EDGES = sorted({f"{a}>{b}" for a, follow in NEXT.items() for b in follow} | {f"{a}>{a}" for a in REPEATABLE})


def allowed(current: Column, target: Column) -> Column:
    return F.concat(current, F.lit(">"), target).isin(*EDGES)


def deletable(status: Column) -> Column:
    return ~status.isin(*KEPT)


def replay(requests: DataFrame) -> DataFrame:
    """requests (session_id, at, status) one after the other: session_id, status, accepted, rejected, moves.

    A session has a few dozen requests at most; they are folded in order.
    """
    edges = F.array(*[F.lit(e) for e in EDGES])
    ordered = requests.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("at", "status"))).alias("r"))
    start = F.struct(F.lit(FIRST).alias("status"), F.lit(0).alias("accepted"), F.lit(0).alias("rejected"))

    def step(s: Column, r: Column) -> Column:
        ok = F.array_contains(edges, F.concat(s["status"], F.lit(">"), r["status"]))
        return F.struct(F.when(ok, r["status"]).otherwise(s["status"]).alias("status"), (s["accepted"] + ok.cast("int")).alias("accepted"), (s["rejected"] + (~ok).cast("int")).alias("rejected"))

    return ordered.select("session_id", F.aggregate("r", start, step).alias("s")).select("session_id", "s.status", "s.accepted", "s.rejected")


def lifecycle(requests: DataFrame) -> DataFrame:
    """The same as a stream: a row per request with the status after it and whether it was accepted.

    State is one status per session. Requests of a micro-batch are taken by time;
    a request that comes after later ones of its session is judged against the
    status of that moment, as a reviewed session never starts again by itself.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        current = state.get[0] if state.exists else FIRST
        rows = pd.concat(list(batches)).sort_values(["at", "status"])
        out = []
        for r in rows.itertuples():
            ok = f"{current}>{r.status}" in EDGES
            current = r.status if ok else current
            out.append((key[0], r.at, r.status, current, ok))
        state.update((current,))
        yield pd.DataFrame(out, columns=["session_id", "at", "requested", "status", "accepted"])

    return requests.groupBy("session_id").applyInPandasWithState(run, "session_id long, at long, requested string, status string, accepted boolean", "status string", "append", "NoTimeout")
