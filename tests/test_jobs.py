import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.operators import jobs
from sightline.vocab import JOB_ERRORS

START = dt.datetime(2024, 1, 1)
SCHEMA = "infohash string, outcome string, error string, ts timestamp"


def model(events):
    """Plain state machine over (outcome, error, minute) of one id."""
    state = None
    for outcome, error, minute in sorted(events, key=lambda e: (e[2], e[0] == "verified")):
        at = START + dt.timedelta(minutes=minute)
        if outcome == "verified":
            state = None
            continue
        before = state[1] if state else 0
        if before + 1 >= 4 or (error == "no_peers" and before >= 1):
            state = ("dead", before + 1, None, error, at)
        else:
            state = ("failed", before + 1, at + dt.timedelta(seconds=60 * 2**before), error, at)
    return state


event = st.one_of(
    st.tuples(st.just("failed"), st.sampled_from(JOB_ERRORS)), st.just(("verified", None))
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(event, max_size=9), min_size=1, max_size=12))
def test_fold_against_state_machine(spark, sequences):
    # two minutes apart, so slices of five minutes cut every sequence
    logs = {
        f"id{n}": [(o, e, 2 * i) for i, (o, e) in enumerate(seq)] for n, seq in enumerate(sequences)
    }
    rows = [
        (k, o, e, START + dt.timedelta(minutes=m)) for k, seq in logs.items() for o, e, m in seq
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {
        r.infohash: (r.status, r.retry_count, r.next_retry_at, r.last_error, r.updated_at)
        for r in jobs.fold_outcomes(df, slice_seconds=300).collect()
    }
    expected = {k: model(seq) for k, seq in logs.items()}
    assert got == {k: v for k, v in expected.items() if v}


def fold(spark, *events, **options):
    rows = [("a", o, e, START + dt.timedelta(minutes=m)) for o, e, m in events]
    return jobs.fold_outcomes(spark.createDataFrame(rows, SCHEMA), **options).collect()


def test_failure_and_success_of_one_moment_leave_no_job(spark):
    assert fold(spark, ("verified", None, 5), ("failed", "no_metadata", 5)) == []


def test_second_no_peers_is_final(spark):
    row, = fold(spark, ("failed", "source_timeout", 0), ("failed", "no_peers", 1))
    assert (row.status, row.retry_count, row.next_retry_at) == ("dead", 2, None)


def test_table_schedule(spark):
    row, = fold(spark, ("failed", "no_peers", 0), ("failed", "no_peers", 9), schedule="table")
    assert row.status == "failed"
    assert row.next_retry_at == START + dt.timedelta(minutes=9, seconds=300)


@pytest.fixture
def queue(spark):
    rows = [(f"p{i:02}", "pending", 0, None) for i in range(3)]
    rows += [(f"f{i:02}", "failed", i % 4, START) for i in range(20)]
    rows += [("late", "failed", 0, START + dt.timedelta(days=1)), ("out", "failed", 4, START)]
    return spark.createDataFrame(rows, "infohash string, status string, retry_count int, next_retry_at timestamp")


def test_claim_shares_do_not_lend(spark, queue):
    from pyspark.sql import functions as F

    got = [r.infohash for r in jobs.claim_due(queue, F.lit(START), 10).collect()]
    assert sorted(got) == ["f00", "f04", "f08", "p00", "p01", "p02"]


def test_claim_of_one(spark, queue):
    from pyspark.sql import functions as F

    assert sorted(r.infohash for r in jobs.claim_due(queue, F.lit(START), 1).collect()) == ["f00", "p00"]
