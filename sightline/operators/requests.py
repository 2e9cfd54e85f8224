"""Requests and replies of one transaction id: the rule that batch and stream share.

An id has at most one open request. A request that comes while one is open is refused and leaves it
open. A reply closes the open request (answered); a reply that finds none is dropped. A request
that is still open when its timeout has passed is closed then (timeout); up to and including that moment
it can be answered. Events of one moment are taken in the order of their tie.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator

import pyarrow as pa

#: (time in microseconds, tie) of an open request.
Open = tuple[int, object] | None
ANSWERED, TIMEOUT, REFUSED = "answered", "timeout", "refused"


def walk(open_: Open, events: Iterable[tuple[int, object, bool]], timeout_us: int) -> Generator[tuple, None, Open]:
    """Go through (time, tie, is a request) in order; yields (outcome, sent, tie, reply time) and
    returns the request that is open at the end."""
    for now, tie, asks in events:
        if open_ is not None and now > open_[0] + timeout_us:
            yield TIMEOUT, *open_, None
            open_ = None
        if asks and open_ is None:
            open_ = now, tie
        elif asks:
            yield REFUSED, now, tie, None
        elif open_ is not None:
            yield ANSWERED, *open_, now
            open_ = None
    return open_


def walk_batches(batches: Iterator[pa.RecordBatch], timeout_us: int) -> Iterator[pa.RecordBatch]:
    """Walk rows (key, stretch, time, tie, is a request) that come stretch by stretch in order.

    A stretch may go on over many batches; one open request is all that is kept of it.
    """
    now, open_, kind = None, None, None

    def close(out: list[tuple]) -> None:
        if open_ is not None:
            out.append((now[0], TIMEOUT, *open_, None))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        key, outcome, sent, tie, reply = zip(*out) if out else [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(key, kind[0]), pa.array(sent, pa.int64()), pa.array(tie, kind[1]),
             pa.array(outcome, pa.string()), pa.array(reply, pa.int64())],
            ["key", "sent", "tie", "outcome", "reply"],
        )

    for batch in batches:
        kind, out = (batch.schema.field(0).type, batch.schema.field(3).type), []
        columns = [batch.column(c).to_pylist() for c in range(5)]
        for key, stretch, us, tie, asks in zip(*columns):
            if (key, stretch) != now:
                close(out)
                now, open_ = (key, stretch), None
            steps = walk(open_, [(us, tie, asks)], timeout_us)
            while True:
                try:
                    out.append((key, *next(steps)))
                except StopIteration as end:
                    open_ = end.value
                    break
        yield batch_of(out)
    if kind is not None:
        out = []
        close(out)
        yield batch_of(out)
