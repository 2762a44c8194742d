import sys
import uuid
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.functions.calendar import with_calendar  # noqa: E402
from tidemark.session import drop_scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", partitions=8)
    # Compiling a plan takes longer than running it on a handful of rows.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    drop_scratch(session)
    session.stop()


@pytest.fixture
def count_jobs(spark):
    """Runs a function and returns its result with the number of jobs it took. With adaptive execution every
    shuffle is a job of its own."""

    def run(job):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "counted")
        try:
            result = job()
        finally:
            spark.sparkContext.setJobGroup("other", "")
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    return run


@pytest.fixture(scope="session")
def make_series(spark):
    """Observations from a list of volumes, one per hour unless hours are given."""

    def make(volumes, hours=None, start=datetime(2024, 1, 1), **extra):
        hours = range(len(volumes)) if hours is None else hours
        rows = [
            (i, start + timedelta(hours=int(h)), None if v is None else float(v), *(c[i] for c in extra.values()))
            for i, (v, h) in enumerate(zip(volumes, hours))
        ]
        schema = "obs_id bigint, date_time timestamp_ntz, traffic_volume double"
        schema += "".join(f", {name} {'double' if isinstance(c[0], float) else 'string'}" for name, c in extra.items())
        return with_calendar(spark.createDataFrame(rows, schema))

    return make
