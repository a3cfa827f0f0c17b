"""Tokens of any width come back, requests are counted without a shuffle, idle streams end."""

from __future__ import annotations

import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

from conftest import ROOT
from veilframe.operators import metrics
from veilframe.operators.redact import explode_findings, redact_text
from veilframe.operators.rehydrate import rehydrate
from veilframe.streaming.sse import frame_events


@pytest.mark.parametrize("width", [1, 5, 6, 64])
def test_every_width_is_restored(spark, width):
    df = spark.createDataFrame([(1, "mail a@b.io or 10.0.0.1, see [SECTION_2]")], "id long, text string")
    red = redact_text(df, width=width)
    vault = explode_findings(red, ["id"]).select("token", "value")
    out = rehydrate(red.select("id", "redacted"), ["id"], ["redacted"], vault)
    assert red.first().redacted.count("[") == 3 and out.first().redacted == df.first().text


def test_requests_are_counted_within_their_rows(spark):
    rows = [(1, "a@b.io a@b.io 10.0.0.1"), (2, "a@b.io"), (3, "clean"), (4, None)]
    red = redact_text(spark.createDataFrame(rows, "request_id long, text string"))
    exploded = explode_findings(red, ["request_id"])
    for report in (metrics.pii_by_type, metrics.pii_by_label, metrics.request_token_count):
        whole, apart = report(red), report(exploded)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, apart.collect()))
    plan = metrics.request_token_count(red)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


class State:
    """A group's state as Spark hands it over."""

    def __init__(self) -> None:
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):  # noqa: N802 - Spark's name
        self.timeout = ms


def test_idle_event_streams_lose_their_state():
    state, run = State(), frame_events(40, idle_seconds=5)
    batch = pd.DataFrame({"stream_id": [1], "seq": [0], "chunk": ["data: {"]})
    assert len(list(run((1,), iter([batch]), state))) == 1 and state.timeout == 5000 and state.exists
    state.hasTimedOut = True
    assert list(run((1,), iter([]), state)) == [] and not state.exists


def test_entry_without_the_training_subpackage(tmp_path):
    """Also where only an empty folder of it is left."""
    for empty in (False, True):
        at = tmp_path / str(empty)
        shutil.copytree(ROOT / "veilframe", at / "veilframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(ROOT / "__spark_entry__.py", at)
        if empty:
            (at / "veilframe" / "llm").mkdir()
            (at / "corpus_pipeline.py").write_text("from veilframe.llm import langid\n")
        code = "import __spark_entry__ as e; q = e.queries(); print('redact_text' in q, any(n.startswith('op') for n in q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, timeout=300)
        assert out.stdout.strip().endswith("True False"), out.stderr[-800:]


def test_functions_travel_by_value():
    from pyspark import cloudpickle

    module = importlib.import_module("veilframe.operators.patterns")
    assert b"piece_hashes" in cloudpickle.dumps(module.piece_hashes)
    code = "import pickle, sys; f = pickle.load(sys.stdin.buffer); print(len(f('abcd', 2)))"
    out = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(module.piece_hashes), cwd=Path("/"), capture_output=True, timeout=300)
    assert out.stdout.strip() == b"3", out.stderr[-500:]
