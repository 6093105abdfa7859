import numpy as np
import pytest

from colloquy.operators.planning import ALIKE, SPREAD, USER_ANSWER
from colloquy.streaming import answers as A


def graph(rng, n, k, m, same, different):
    pairs = rng.permutation([(i, j) for i in range(n) for j in range(i)])[:m]
    return rng.normal(size=(n, k)) * 1.5, pairs[:, 0], pairs[:, 1], np.full(m, np.log(same)), np.full(m, np.log(different)), rng.random(m)


def whole(phi, left, right, same, different):
    """A table of messages from every line to every other, from nothing until they stand still."""
    n, k = phi.shape
    s, d, there = np.ones((n, n, 1)), np.ones((n, n, 1)), np.zeros((n, n, 1), bool)
    for i, j in ((left, right), (right, left)):
        s[i, j, 0], d[i, j, 0], there[i, j, 0] = np.exp(same), np.exp(different), True
    message = np.zeros((n, n, k))
    for _ in range(4000):
        base = (phi + message.sum(0))[:, None, :] - message.transpose(1, 0, 2)
        e = np.exp(base - base.max(2, keepdims=True))
        fresh = np.log(np.maximum((e.sum(2, keepdims=True) - e) * d + e * s, 1e-300))
        fresh = np.where(there, fresh - fresh.max(2, keepdims=True), 0.0)
        if np.abs(fresh - message).max() < 1e-11:
            break
        message = (message + fresh) / 2
    log = phi + message.sum(0)
    e = np.exp(log - log.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@pytest.mark.parametrize("same,per_line", [(0.6, 1.0), (0.6, 2.0), (0.7, 4.0), (0.9, 0.4)])
def test_updates_find_what_a_whole_run_finds(same, per_line):
    rng = np.random.default_rng(int(per_line * 10))
    for _ in range(3):
        phi, left, right, s, d, like = graph(rng, 40, 4, int(40 * per_line), same, 1 - same)
        own, by_hand = A.Loop(phi, left, right, s, d, like), phi.copy()
        assert np.abs(own.posteriors() - whole(by_hand, left, right, s, d)).max() < 1e-6
        answered = []
        for _ in range(6):
            line, c = int(rng.integers(0, 40)), int(rng.integers(0, 4))
            before = own.sent
            own.answer(line, c)
            answered.append(line)
            by_hand[line, c] += USER_ANSWER
            for a, b, x in [*zip(left, right, like), *zip(right, left, like)]:
                if a == line and x >= ALIKE and b not in answered:
                    by_hand[b, c] += SPREAD * x
            assert np.abs(own.phi - by_hand).max() < 1e-12
            assert np.abs(own.posteriors() - whole(by_hand, left, right, s, d)).max() < 1e-6
            if own.strength < 1:
                # fewer messages than a whole run, but where everything is near everything
                assert own.sent - before < A.Loop(by_hand, left, right, s, d, like).sent * (1 if per_line < 2 else 1.5)


def test_far_lines_hear_nothing():
    n = 4000
    left = np.arange(n - 1)
    left, right = left[left % 20 != 19], left[left % 20 != 19] + 1  # chains of twenty lines
    phi = np.random.default_rng(2).normal(size=(n, 3))
    own = A.Loop(phi, left, right, np.full(len(left), np.log(0.7)), np.full(len(left), np.log(0.3)), np.zeros(len(left)))
    before, p = own.sent, own.posteriors()
    own.answer(2010, 1)
    assert own.strength < 1 and own.sent - before < 38 * 60 and (np.abs(own.posteriors() - p).max(1) > 0).sum() <= 20


def test_state_round_trip():
    own = A.Loop(*graph(np.random.default_rng(3), 30, 4, 30, 0.6, 0.4))
    own.answer(3, 1)
    again = A.Loop.unpacked(own.packed())
    own.answer(5, 0)
    again.answer(5, 0)
    assert np.array_equal(own.posteriors(), again.posteriors()) and (own.asked, own.sent) == (again.asked, again.sent)


def test_why_a_review_ends():
    make = lambda: A.Loop(*graph(np.random.default_rng(4), 10, 3, 8, 0.6, 0.4))
    own = make()
    assert own.ended() == "" and own.ended(0) == "no_candidates"
    own.answer(0, None)
    own.answer(1, 0)
    own.answer(1, None)
    assert own.ended() == ""
    own.answer(2, None)
    assert own.ended() == "repeated_dont_know"
    own = make()
    for i in range(8):
        own.answer(i, 0)
    assert own.ended() == "budget"


def events(rng, sessions):
    rows = []
    for s in sessions:
        phi, left, right, same, different, like = graph(rng, 12, 3, 12, 0.6, 0.4)
        rows += [(s, -1, "node", i, None, f"c{c}", float(phi[i, c]), None, None) for i in range(12) for c in range(3)]
        rows += [(s, -1, "edge", int(a), int(b), None, float(x), float(y), float(z)) for a, b, x, y, z in zip(left, right, same, different, like)]
    return rows, [(s, q, "answer", int(rng.integers(0, 12)), None, [None, "c0", "c1", "c2", "?"][int(rng.integers(0, 5))], None, None, None) for q in range(10) for s in sessions]


def test_the_stream_is_the_replay(spark, tmp_path):
    rng = np.random.default_rng(5)
    load, told = events(rng, range(5))
    told += [(77, 0, "answer", 1, None, "c0", None, None, None), (0, 50, "answer", 999, None, "c0", None, None, None)]
    at = tmp_path / "in"
    batches = [load, told[:13], told[13:40], told[40:]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, A.EVENTS).coalesce(1).write.parquet(f"file://{at}/{k}")
    stream = spark.readStream.schema(A.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{at}")
    query = A.answer_stream(stream).writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r.session_id, r.seq, -1 if r.ref is None else r.ref, r.candidate or "")
    got = {key(r): (r.p, r.asked, r.sent, r.ended) for r in spark.table("moves").collect() if r.session_id != 77}
    want = {key(r): (r.p, r.asked, r.sent, r.ended) for r in A.replayed(spark.createDataFrame(load + told, A.EVENTS)).collect() if r.session_id != 77}
    assert set(got) == set(want) and len(want) > 100
    assert all(got[k][1:] == want[k][1:] and (got[k][0] is None or abs(got[k][0] - want[k][0]) < 1e-9) for k in want)
    assert {r.ended for r in spark.table("moves").collect()} & {"budget", "repeated_dont_know"}
    assert spark.table("moves").filter("session_id = 77 AND ref IS NULL").count() == 1
