"""The bucketed vault store, and chunk streams on a vault that grows."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import model
import pytest
from pyspark.sql import functions as F

from veilframe.operators.vault import vault_upsert
from veilframe.sources import vault_store as vs
from veilframe.sources.vault_store import VaultStore
from veilframe.streaming import held, jobs
from veilframe.streaming.sinks import read_stream

T0 = dt.datetime(2024, 1, 1)
CHUNKS = "stream_id long, seq long, chunk string"


def saves(spark, rows):
    """Saves from (token, value, second)."""
    return spark.createDataFrame(
        [(t, "L", v, T0 + dt.timedelta(seconds=s), i, 0) for i, (t, v, s) in enumerate(rows)], vs.SAVE_SCHEMA)


def token(n: int) -> str:
    return f"[USER_EMAIL_{n:06x}]"


def files(path: str) -> dict[str, int]:
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def as_dict(vault) -> dict:
    return {r.token: (r.value, r.saved_at) for r in vault.collect()}


def test_an_append_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "vault")
    store = VaultStore(spark, path, rows_per_bucket=25)
    first = saves(spark, [(token(i), f"v{i}", 0) for i in range(400)])
    assert store.append(first) == 0
    bits = store.manifest()[0].bits
    assert bits == 4 and {r.bucket for r in store.manifest()} == set(range(16))
    before = files(path)
    new = saves(spark, [(token(3), "newer", 9), (token(1000), "fresh", 9)])
    touched = {r[0] for r in new.select(vs.bucket_of("token", bits)).collect()}
    assert store.append(new) == 1
    after = files(path)
    assert {f: t for f, t in after.items() if f in before} == before
    added = {int(f.split("bucket=")[1].split("/")[0]) for f in after if f not in before and "bucket=" in f}
    assert added == touched
    assert as_dict(store.read()) == as_dict(vault_upsert(first.unionByName(new)))
    assert as_dict(store.read(0)) == as_dict(vault_upsert(first))


def test_buckets_are_merged_when_their_appends_have_grown(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "vault"), rows_per_bucket=50)
    rows = [(token(i), f"v{i}", i) for i in range(100)]
    store.append(saves(spark, rows))
    for n in range(6):
        more = [(token(i), f"w{n}-{i}", 1000 + n) for i in range(10 * n, 10 * n + 10)]
        rows += more
        store.append(saves(spark, more))
        folders: dict = {}
        for r in store.manifest():
            folders.setdefault(r.bucket, []).append(r.n)
        assert all(2 * sum(x[1:]) < x[0] for x in folders.values())
    assert as_dict(store.read()) == as_dict(vault_upsert(saves(spark, rows)))
    assert store.unreferenced(keep=1) and not set(store.unreferenced(1)) & {
        store.folder(r.gen, r.bucket) for r in store.manifest()}
    store.append(saves(spark, [(token(i), "x", 5000) for i in range(2000, 3000)]))
    count = store.read().count()
    store.rebucket()
    assert {r.bits for r in store.manifest()} == {5} and store.read().count() == count


def test_lookups_open_the_buckets_asked_for(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "vault"), rows_per_bucket=10)
    store.append(saves(spark, [(token(i), f"v{i}", i) for i in range(300)]))
    asked = spark.createDataFrame([(token(7),), (None,), (token(9999),)], "token string")
    found = store.read(tokens=asked)
    opened = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(opened) <= 2 and as_dict(found)[token(7)][0] == "v7"
    assert set(as_dict(store.read(ttl_seconds=10))) == {token(i) for i in range(289, 300)}
    assert set(as_dict(store.read(tokens=asked, ttl_seconds=10))) <= {token(i) for i in range(289, 300)}


def test_empty_and_repeated_appends(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "vault"))
    assert store.latest() == -1 and store.read().collect() == [] and store.longest() == 0
    assert store.append(saves(spark, []), tag="batch 0") == 0
    assert store.append(saves(spark, [("[A_1]", "x", 1)]), tag="batch 1") == 1
    assert store.append(saves(spark, [("[A_1]", "x", 1)]), tag="batch 1") == 1
    assert store.append(saves(spark, []), tag="batch 2") == 2
    assert as_dict(store.read()) == {"[A_1]": ("x", T0 + dt.timedelta(seconds=1))} and store.longest() == 5


# Chunk streams


class Growing(VaultStore):
    """Micro-batch n sees version n."""

    def pin(self, batch: int) -> int:
        return min(batch, self.latest())


def run(spark, tmp_path, batches, appends, **options):
    """Chunks by micro-batch on a store that has one more append with each; shown by stream."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Growing(spark, str(tmp_path / "vault"), rows_per_bucket=2)
    for rows in appends:
        store.append(saves(spark, rows))
    stream = read_stream(spark, str(tmp_path / "in"), CHUNKS, 1)
    out = str(tmp_path / "out")
    jobs.stream_chunks(stream, store, out, str(tmp_path / "ck"), **options).awaitTermination()
    shown: dict = {}
    for r in spark.read.parquet(out).orderBy("stream_id", "seq").collect():
        shown.setdefault(r.stream_id, []).append(r.emitted)
    return shown, store


def test_a_token_saved_between_its_halves_shows_nothing_twice(spark, tmp_path):
    t = token(0xABCDEF)
    batches = [
        [(1, 0, "a " + t[:9]), (2, 0, "b "), (3, 0, "c " + t[:5]), (4, 0, t[:4])],
        [(1, 1, t[9:] + " z"), (2, 1, t[:9]), (3, 1, t[5:9]), (4, 1, ""), (4, 2, t[4:12])],
        [(2, 2, t[9:] + " z"), (3, 2, t[9:] + " " + t[:3]), (4, 3, t[12:])],
        [(3, 3, t[3:])],
    ]
    shown, _ = run(spark, tmp_path, batches, [[("[OTHER_1]", "o", 0)], [(t, "Ann", 1)]])
    assert shown == {
        1: ["a " + t[:9], t[9:] + " z"],  # shown before the token was saved, and not again
        2: ["b ", "", "Ann z"],  # saved by the micro-batch of its beginning
        3: ["c " + t[:5], t[5:9], t[9:] + " ", "Ann"],
        4: [t[:4], "", t[4:12], t[12:]],
    }


def test_what_was_held_is_shown_where_the_vault_forgets(spark, tmp_path):
    """The vault is any reader; the token is gone when its second half comes."""
    t = token(5)
    reads = iter([{t: "Ann"}, {}])
    for n, piece in enumerate((f"a {t[:8]}", t[8:])):
        spark.createDataFrame([(1, n, piece)], CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def vault():
        rows = list(next(reads).items())
        return spark.createDataFrame(rows, "token string, value string")

    stream = read_stream(spark, str(tmp_path / "in"), CHUNKS, 1)
    jobs.stream_chunks(stream, vault, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    shown = [r.emitted for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert shown == ["a ", t]


def test_a_micro_batch_that_runs_again_gives_the_same(spark, tmp_path):
    t = token(1)
    store = VaultStore(spark, str(tmp_path / "vault"))
    store.append(saves(spark, [("[OTHER_1]", "o", 0)]))
    step = held.micro_batch(store, str(tmp_path / "state"), None, False)
    one = spark.createDataFrame([(1, 0, "x " + t[:6]), (2, 0, "[OTH")], CHUNKS)
    two = spark.createDataFrame([(1, 1, t[6:]), (2, 1, "ER_1]")], CHUNKS)
    first = sorted(map(tuple, step(one, 0).collect()))
    second = sorted(map(tuple, step(two, 1).collect()))
    store.append(saves(spark, [(t, "Ann", 1)]))  # the vault has grown when both run again
    assert sorted(map(tuple, step(one, 0).collect())) == first == [(1, 0, "x " + t[:6]), (2, 0, "")]
    assert sorted(map(tuple, step(two, 1).collect())) == second == [(1, 1, t[6:]), (2, 1, "o")]
    three = spark.createDataFrame([(1, 2, t)], CHUNKS)
    assert [r.emitted for r in step(three, 2).collect()] == ["Ann"]


@pytest.mark.parametrize("flush", [False, True])
def test_idle_streams_end(spark, tmp_path, flush):
    store = VaultStore(spark, str(tmp_path / "vault"))
    store.append(saves(spark, [(token(1), "Ann", 0)]))
    folder = str(tmp_path / "state")
    step = held.micro_batch(store, folder, 10, flush)
    step(spark.createDataFrame([(1, 0, "a [USER"), (2, 0, "b [US")], CHUNKS), 0).collect()
    kept = spark.read.schema(held.HELD_SCHEMA).parquet(f"{folder}/held/batch=0")
    assert sorted((r.stream_id, r.text) for r in kept.collect()) == [(1, "[USER"), (2, "[US")]
    # stream 1 was last seen long ago
    old = kept.withColumn("at", F.when(F.col("stream_id") == 1, F.col("at") - 60_000_000).otherwise(F.col("at")))
    rows = [tuple(r) for r in old.collect()]
    spark.createDataFrame(rows, held.HELD_SCHEMA).write.mode("overwrite").parquet(f"{folder}/held/batch=0")
    shown = sorted(map(tuple, step(spark.createDataFrame([(3, 0, "c")], CHUNKS), 1).collect()))
    assert shown == ([(1, 1, "[USER")] if flush else []) + [(3, 0, "c")]
    left = spark.read.schema(held.HELD_SCHEMA).parquet(f"{folder}/held/batch=1").collect()
    assert [(r.stream_id, r.text) for r in left] == [(2, "[US")]


def test_growing_streams_match_the_model(spark, tmp_path):
    """Long streams in small chunks over four micro-batches; one stream has most chunks."""
    texts = {i: " ".join(f"{token(n * 7 + i)} word{n} [no {n}]" for n in range(8 if i else 60)) for i in range(6)}
    rows = [(i, n, t[a : a + 7]) for i, t in texts.items() for n, a in enumerate(range(0, len(t), 7))]
    batches = [[r for r in rows if min(r[1] // 12, 3) == b] for b in range(4)]
    every = sorted({token(n * 7 + i) for i in texts for n in range(60)})
    appends = [[(t, f"<{t[-3:-1]}>", 0) for j, t in enumerate(every) if j % 4 == a] for a in range(4)]
    shown, _ = run(spark, tmp_path, batches, appends)
    for i, t in texts.items():
        want, rest, known = [], "", {}
        for b in range(4):
            known |= {x[0]: x[1] for x in appends[b]}
            for _, n, chunk in (r for r in batches[b] if r[0] == i):
                buffer = rest + chunk
                cut = max((k for k in range(1, len(buffer) + 1) if any(x.startswith(buffer[-k:]) and x != buffer[-k:] for x in known)), default=0)
                rest = buffer[len(buffer) - cut :]
                want.append(model.rehydrate(buffer[: len(buffer) - cut], known))
        assert shown[i] == want, i
