"""The answer loop of a review: belief kept as state by session, updated around each answer.

A session's state is its graph with the messages that travel along its edges. An
answer changes the potentials of a few lines; messages are sent again only where
what they say has changed, and so on from there, until nothing changes any more. The
loop ends by the reference's rules: a budget of questions, answers of "I don't know"
in a row, or nothing left to ask.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.kernels import MISSING
from colloquy.operators.planning import ALIKE, SPREAD, USER_ANSWER

#: A message that would change by less isn't sent again; sweeps of a whole run and rounds of an update at most.
STILL, SWEEPS, ROUNDS = 1e-10, 2000, 2000
DAMPING = 0.5
#: Questions of a review, and answers of no use in a row, after which it ends.
MOST_QUESTIONS, MOST_UNSURE = 8, 2


def coupling(n: int, left: np.ndarray, right: np.ndarray, same: np.ndarray, different: np.ndarray) -> float:
    """How much a change of messages can grow in a round: under 1 there is one fixed point, which every way of sending finds.

    The largest eigenvalue of the matrix of edges that follow each other without
    turning back, each weighted by the most that its potential passes on.
    """
    if not len(left):
        return 0.0
    src, dst = np.concatenate([left, right]), np.concatenate([right, left])
    back = np.concatenate([np.arange(len(left)) + len(left), np.arange(len(left))])
    weight = np.tile(np.tanh(np.abs(same - different) / 2), 2)
    x, size = np.ones(len(src)), 0.0
    for _ in range(60):
        y = weight * (np.bincount(dst, x, n)[src] - x[back])
        size = float(np.linalg.norm(y) / max(np.linalg.norm(x), 1e-300))
        if size == 0:
            break
        x = y / np.linalg.norm(y)
    return size


class Loop:
    """One session: potentials (lines by candidates), edges, likeness of lines, messages, and how the review stands."""

    def __init__(self, phi: np.ndarray, left: np.ndarray, right: np.ndarray, same: np.ndarray, different: np.ndarray, likeness: np.ndarray):
        self.phi = phi.astype(float)
        self.left, self.right, self.same, self.different, self.likeness = left, right, same, different, likeness
        self.message = np.zeros((2 * len(left), self.phi.shape[1]))
        self.answered: list[int] = []
        self.asked = self.unsure = self.sent = 0
        self._index()
        self.strength = coupling(len(phi), left, right, same, different)
        self.whole()

    def _index(self) -> None:
        n = len(self.left)
        self.src, self.dst = np.concatenate([self.left, self.right]), np.concatenate([self.right, self.left])
        self.back = np.concatenate([np.arange(n) + n, np.arange(n)])
        self.s, self.d = np.exp(np.tile(self.same, 2))[:, None], np.exp(np.tile(self.different, 2))[:, None]
        order = np.argsort(self.src, kind="stable")
        self.by_source, self.first = order, np.searchsorted(self.src[order], np.arange(len(self.phi) + 1))

    def _beliefs(self) -> np.ndarray:
        """log beliefs of all lines."""
        out = self.phi.copy()
        np.add.at(out, self.dst, self.message)
        return out

    def _fresh(self, edges: np.ndarray, log: np.ndarray) -> np.ndarray:
        """What these edges have to say, each message normalised so that its largest part is 0."""
        base = log[self.src[edges]] - self.message[self.back[edges]]
        e = np.exp(base - base.max(1, keepdims=True))
        out = np.log(np.maximum((e.sum(1, keepdims=True) - e) * self.d[edges] + e * self.s[edges], 1e-300))
        return out - out.max(1, keepdims=True)

    def whole(self) -> None:
        """All messages from nothing, sweep by sweep."""
        self.message[:] = 0
        every = np.arange(len(self.src))
        for _ in range(SWEEPS if len(every) else 0):
            fresh = self._fresh(every, self._beliefs())
            moved = np.abs(fresh - self.message).max()
            self.message += (1 - DAMPING) * (fresh - self.message)
            self.sent += len(every)
            if moved < STILL:
                break

    def _out(self, lines: np.ndarray) -> np.ndarray:
        return np.concatenate([self.by_source[self.first[i] : self.first[i + 1]] for i in lines]) if len(lines) else np.zeros(0, np.int64)

    def around(self, lines: list[int]) -> None:
        """Sends again what changes, from these lines on. Where couplings are so strong that there may be several fixed points, all from nothing, as only that tells which one a whole run finds."""
        if self.strength >= 1:
            return self.whole()
        log = self._beliefs()
        edges = np.unique(self._out(np.unique(lines)))
        for _ in range(ROUNDS):
            if not len(edges):
                return None
            change = self._fresh(edges, log) - self.message[edges]
            self.sent += len(edges)
            keep = np.abs(change).max(1) >= STILL
            edges, change = edges[keep], (1 - DAMPING) * change[keep]
            self.message[edges] += change
            np.add.at(log, self.dst[edges], change)
            # an edge that still moves, and all that start where it ends
            edges = np.unique(np.concatenate([edges, self._out(np.unique(self.dst[edges]))]))
        return self.whole()

    def answer(self, line: int, candidate: int | None) -> None:
        """Someone says who spoke a line, or that they don't know; alike lines that nobody has answered take a share."""
        self.asked += 1
        if candidate is None:
            self.unsure += 1
            return
        self.unsure = 0
        self.phi[line, candidate] += USER_ANSWER
        self.answered.append(line)
        moved = [line]
        for a, b, like in zip(np.concatenate([self.left, self.right]), np.concatenate([self.right, self.left]), np.tile(self.likeness, 2), strict=True):
            if a == line and like >= ALIKE and int(b) not in self.answered:
                self.phi[b, candidate] += SPREAD * like
                moved.append(int(b))
        self.around(moved)

    def posteriors(self) -> np.ndarray:
        log = self._beliefs()
        e = np.exp(log - log.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def ended(self, left: int = 1) -> str:
        """Why there is no next question, or the empty string."""
        return "budget" if self.asked >= MOST_QUESTIONS else "repeated_dont_know" if self.unsure >= MOST_UNSURE else "no_candidates" if left <= 0 else ""

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, phi=self.phi, left=self.left, right=self.right, same=self.same, different=self.different, likeness=self.likeness, message=self.message, answered=np.array(self.answered, np.int64), counts=np.array([self.asked, self.unsure, self.sent]), strength=np.array(self.strength))
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Loop:
        x = np.load(io.BytesIO(data))
        own = cls.__new__(cls)
        own.phi, own.left, own.right, own.same, own.different, own.likeness, own.message = (x[k] for k in ("phi", "left", "right", "same", "different", "likeness", "message"))
        own.answered, (own.asked, own.unsure, own.sent), own.strength = x["answered"].tolist(), (int(v) for v in x["counts"]), float(x["strength"])
        own._index()
        return own


EVENTS = "session_id long, seq long, kind string, i long, j long, candidate string, a double, b double, c double"
MOVES = "session_id long, seq long, ref long, candidate string, p double, asked int, sent long, ended string"


class _Session:
    """Events of one session in order: node (i, candidate, a: log potential), edge (i, j, a: log same, b: log different, c: likeness), answer (i, candidate or null)."""

    def __init__(self, refs: list, names: list[str], loop: Loop):
        self.refs, self.names, self.loop = refs, names, loop

    @classmethod
    def of(cls, rows: pd.DataFrame) -> _Session | None:
        node = rows[rows["kind"] == "node"]
        if node.empty:
            return None
        wide = node.pivot_table(index="i", columns="candidate", values="a", fill_value=MISSING, aggfunc="last")
        at = {r: k for k, r in enumerate(wide.index)}
        e = rows[(rows["kind"] == "edge") & rows["i"].isin(at) & rows["j"].isin(at) & (rows["i"] != rows["j"])].sort_values(["i", "j"])
        column = lambda c: e[c].fillna(0.0).to_numpy(float)
        return cls(list(wide.index), list(wide.columns), Loop(wide.to_numpy(float), e["i"].map(at).to_numpy(np.int64), e["j"].map(at).to_numpy(np.int64), column("a"), column("b"), column("c")))

    def moves(self, session, answers: pd.DataFrame, least: float) -> Iterator[pd.DataFrame]:
        at, name = {r: k for k, r in enumerate(self.refs)}, {c: k for k, c in enumerate(self.names)}
        for r in answers.sort_values("seq").itertuples():
            ended = self.loop.ended()
            before, sent = self.loop.posteriors(), self.loop.sent
            told = None if pd.isna(r.candidate) or r.candidate not in name else name[r.candidate]
            if not ended and r.i in at:
                self.loop.answer(at[r.i], told)
            p = self.loop.posteriors()
            ref, cand = np.nonzero(np.abs(p - before) >= least)
            out = {"ref": [self.refs[k] for k in ref], "candidate": [self.names[k] for k in cand], "p": p[ref, cand]}
            if not len(ref):
                out = {"ref": [None], "candidate": [None], "p": [None]}
            made = pd.DataFrame(out).assign(session_id=session, seq=r.seq, asked=self.loop.asked, sent=self.loop.sent - sent, ended=self.loop.ended())
            yield made.astype({"ref": "Int64"})[["session_id", "seq", "ref", "candidate", "p", "asked", "sent", "ended"]]


def answer_stream(events: DataFrame, least: float = 1e-3) -> DataFrame:
    """A stream of EVENTS to one of MOVES: for every answer the posteriors that it moves by ``least`` or more (a row with a null ref if none), how many messages it took, and whether the review has ended.

    A session's nodes and edges come in one micro-batch, before its first answer;
    answers in the order of seq within a micro-batch. State is keyed by session:
    the graph and its messages. Answers to lines or sessions that aren't known and
    those after the end move nothing; an unknown candidate counts as "I don't know".
    """

    def run(key, batches, state):
        rows = pd.concat(list(batches))
        own = None
        if state.exists:
            refs, names, data = state.get
            own = _Session(list(refs), list(names), Loop.unpacked(bytes(data)))
        else:
            own = _Session.of(rows)
        answers = rows[rows["kind"] == "answer"]
        if own is None:
            for r in answers.sort_values("seq").itertuples():
                yield pd.DataFrame({"session_id": [key[0]], "seq": [r.seq], "ref": pd.array([None], "Int64"), "candidate": [None], "p": [None], "asked": [0], "sent": [0], "ended": [""]})
            return
        yield from own.moves(key[0], answers, least)
        state.update((own.refs, own.names, own.loop.packed()))

    state = "refs array<long>, names array<string>, data binary"
    return events.groupBy("session_id").applyInPandasWithState(run, MOVES, state, "append", "NoTimeout")


def replayed(events: DataFrame, least: float = 1e-3) -> DataFrame:
    """The same over a finished table of events: one row for each posterior that an answer moved."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = _Session.of(pdf)
        parts = list(own.moves(key[0], pdf[pdf["kind"] == "answer"], least)) if own else []
        return pd.concat(parts) if parts else pd.DataFrame(columns=["session_id", "seq", "ref", "candidate", "p", "asked", "sent", "ended"])

    return events.groupBy("session_id").applyInPandas(run, MOVES)


def events_of(potentials: DataFrame, edges: DataFrame, answers: DataFrame) -> DataFrame:
    """EVENTS from potentials (session_id, ref, candidate, log_phi), edges (session_id, i, j, log_same, log_diff, likeness) and answers (session_id, seq, ref, candidate)."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    nodes = potentials.select("session_id", F.lit(-1).cast("long").alias("seq"), F.lit("node").alias("kind"), F.col("ref").cast("long").alias("i"), none("long", "j"), "candidate", F.col("log_phi").alias("a"), none("double", "b"), none("double", "c"))
    ties = edges.select("session_id", F.lit(-1).cast("long").alias("seq"), F.lit("edge").alias("kind"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), none("string", "candidate"), F.col("log_same").alias("a"), F.col("log_diff").alias("b"), F.col("likeness").alias("c"))
    told = answers.select("session_id", F.col("seq").cast("long").alias("seq"), F.lit("answer").alias("kind"), F.col("ref").cast("long").alias("i"), none("long", "j"), "candidate", none("double", "a"), none("double", "b"), none("double", "c"))
    return nodes.unionByName(ties).unionByName(told)
