import os
import subprocess
import sys
from datetime import timedelta

import pytest

from sluice.config import Backend, RelayConfig
from sluice.plans.catalog import load

PUBSUB, SQS = Backend("pubsub", "topic"), Backend("sqs", "queue")
BARE_PUBSUB, BARE_SQS = Backend("pubsub"), Backend("sqs")


@pytest.mark.parametrize("backends, extra, expected", [
    ((PUBSUB,), {}, ["id", "payload"]),
    ((BARE_PUBSUB,), {}, ["id", "payload", "destination"]),
    ((PUBSUB, SQS), {}, ["id", "payload", "target"]),
    ((PUBSUB, BARE_SQS), {}, ["id", "payload", "target", "destination"]),
    ((PUBSUB,), {"max_age": timedelta(seconds=1)}, ["id", "payload", "timestamp"]),
    ((PUBSUB,), {"target_col": ""}, ["id", "payload"]),
    ((BARE_SQS,), {"destination_col": ""}, ["id", "payload"]),
    ((SQS,), {"payload_col": "body"}, ["id", "body"]),
])
def test_required_columns(backends, extra, expected):
    assert RelayConfig(backends=backends, **extra).required_columns() == expected


@pytest.mark.parametrize("extra", [
    {"batch_target": 0}, {"payload_col": "id"}, {"id_col": ""}, {"dlq_table": "events"},
    {"backends": (PUBSUB, PUBSUB)}, {"backends": (Backend("kafka"),)},
    {"max_age": timedelta(1), "timestamp_col": ""},
])
def test_bad_configuration_is_refused(extra):
    with pytest.raises(ValueError):
        RelayConfig(**{"backends": (PUBSUB,), **extra})


def test_a_configured_route_column_must_exist(spark):
    df = spark.createDataFrame([], "id bigint, payload string")
    with pytest.raises(ValueError, match="target, destination"):
        RelayConfig(backends=(PUBSUB,)).check_columns(df)
    RelayConfig(backends=(PUBSUB,), target_col="", destination_col="").check_columns(df)


@pytest.mark.parametrize("missing", ["zstandard", "corpus_pipeline", "sluice.llm"])
def test_queries_survive_missing_optional_modules(missing):
    """The core's queries stay when the optional subpackage, or a library that only it needs, cannot be imported."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(load()) and int(out[1]) == sum(bool(q.sql) for q in load().values())
