"""Snapshots of observations: commits that die at any step, commits that meet, readers in between, and what is deleted."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from firnline.errors import ConflictError, SourceError
from firnline.sources import ingest as I
from firnline.sources import snapshots as S
from firnline.sources.snapshots import Snapshot

LONG = "date date, variable string, tile_id int, pixel_id long, value double"
DAYS = [dt.date(2020, 1, d) for d in (1, 2, 3)]


class Died(Exception):
    pass


def put(spark, path, values, tag, base=None, merge=False, variables=("depth", "swe")):
    """Commit {(day, variable): value of both pixels}."""
    rows = spark.createDataFrame([(DAYS[d - 1], v, 0, p, float(x + p)) for (d, v), x in values.items() for p in (0, 1)], LONG)
    plan = spark.createDataFrame(sorted({(DAYS[d - 1], f"v1:{tag}", "write") for d, _ in values}), "date date, source_hash string, action string")
    return I.commit(rows, plan, list(variables), path, merge=merge, base=base)


def state(snapshot):
    """What a snapshot holds: the values of its pixels, and its manifest."""
    pixels = {(r.date.day, v, r.pixel_id): r[v] for r in snapshot.observations().collect() for v in ("depth", "swe") if v in r and r[v] is not None}
    return pixels, {(r.date.day, r.variable, r.source_hash) for r in snapshot.manifest().collect()}


def both(x, days=(1, 2)):
    return {(d, v): x * d for d in days for v in ("depth", "swe")}


def dies(monkeypatch, spark, path, act, step, after):
    """Run act with a death before or after the step; gives the state that is left."""
    owner, name = step
    real = getattr(owner, name)

    def dying(*args, **how):
        if after:
            real(*args, **how)
        raise Died

    with monkeypatch.context() as patch:
        patch.setattr(owner, name, dying)
        with pytest.raises(Died):
            act()
    return state(Snapshot.current(spark, path))


STEPS = {"before pixels": (I, "write_pixels", False), "before the manifest": (I, "write_pixels", True), "before the entry": (S, "_claim", False), "after the entry": (S, "_claim", True), "in the vacuum": (S, "delete", False)}


@pytest.mark.parametrize("how", STEPS)
def test_a_commit_of_many_dates_that_dies_leaves_old_or_new(spark, tmp_path, monkeypatch, how):
    path, (owner, name, after) = str(tmp_path), STEPS[how]
    put(spark, path, both(10), "a")
    put(spark, path, both(15), "a2")
    old = state(Snapshot.current(spark, path))
    act = lambda: put(spark, path, both(20, (1, 2, 3)), "b")
    left = dies(monkeypatch, spark, path, act, (owner, name), after)
    done = how in ("after the entry", "in the vacuum")
    new = {(d, v, p): 20.0 * d + p for d in (1, 2, 3) for v in ("depth", "swe") for p in (0, 1)}, {(d, v, "v1:b") for d in (1, 2, 3) for v in ("depth", "swe")}
    assert left == (new if done else old)
    put(spark, path, both(20, (1, 2, 3)), "b")  # the job is run again
    assert state(Snapshot.current(spark, path)) == new
    S.vacuum(spark, path, kept=0, orphans_after=dt.timedelta(seconds=-60))
    assert state(Snapshot.current(spark, path)) == new
    assert len([p for p in (tmp_path / "commits").iterdir() if p.is_dir()]) == 3  # the log, one manifest, one folder of pixels


@pytest.mark.parametrize("step", [(S, "_claim"), (S, "vacuum")], ids=["_claim", "vacuum"])
def test_a_removal_that_dies_leaves_all_or_takes_the_date(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path)
    put(spark, path, both(10), "a")
    left = dies(monkeypatch, spark, path, lambda: I.remove_date(spark, path, "2020-01-01"), step, False)
    assert {d for d, *_ in left[0]} == {d for d, *_ in left[1]} == ({1, 2} if step[1] == "_claim" else {2})


def test_a_reader_keeps_its_snapshot(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, both(10), "a")
    reader = Snapshot.current(spark, path)
    before = state(reader)
    put(spark, path, both(20), "b")
    assert state(reader) == before and state(Snapshot.current(spark, path)) != before
    assert state(Snapshot.at(spark, path, 1)) == before
    put(spark, path, both(30), "c")
    assert not list(tmp_path.glob(f"commits/{reader.folder}"))  # one snapshot stays beside the one in force


def test_commits_that_meet(spark, tmp_path):
    """Of two that build on one snapshot the second joins the first if their dates differ, and is a conflict if not."""
    path = str(tmp_path)
    put(spark, path, both(10), "a")
    base = Snapshot.current(spark, path)
    put(spark, path, both(20, (1,)), "b")
    put(spark, path, both(30, (2, 3)), "c", base=base)
    pixels, manifest = state(Snapshot.current(spark, path))
    assert {(d, h) for d, _, h in manifest} == {(1, "v1:b"), (2, "v1:c"), (3, "v1:c")} and pixels[1, "swe", 0] == 20 and pixels[2, "swe", 0] == 60
    with pytest.raises(ConflictError):
        put(spark, path, both(40, (2,)), "d", base=base)
    assert state(Snapshot.current(spark, path)) == (pixels, manifest)


def test_a_number_is_claimed_once(spark, tmp_path):
    path = str(tmp_path)
    assert S._claim(spark, path, 1, "first") and not S._claim(spark, path, 1, "second")
    assert spark.read.text(f"{path}/commits/log/{1:012d}").first()[0] == "first" and S._numbers(spark, path) == [1]


def test_a_number_that_is_taken_in_the_last_moment(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    put(spark, path, both(10), "a")
    real, met = S._claim, []

    def late(*args):
        if not met:
            met.append(1)
            put(spark, path, both(20, (1,)), "b")
        return real(*args)

    monkeypatch.setattr(S, "_claim", late)
    put(spark, path, both(30, (3,)), "c")
    assert {(d, h) for d, _, h in state(Snapshot.current(spark, path))[1]} == {(1, "v1:b"), (2, "v1:a"), (3, "v1:c")}
    met.clear()
    with pytest.raises(ConflictError):
        put(spark, path, both(40, (1, 3)), "d")


def test_plain_tables_become_snapshots(spark, tmp_path):
    path = str(tmp_path)
    pixels = spark.createDataFrame([(DAYS[k], 0, 0, 5.0 * k) for k in (0, 1)], "date date, tile_id int, pixel_id long, swe double")
    pixels.write.partitionBy("date").parquet(f"{path}/observations")
    spark.createDataFrame([(DAYS[k], "swe", "v1:old") for k in (0, 1)], "date date, variable string, source_hash string").write.partitionBy("date").parquet(f"{path}/manifest")
    assert state(Snapshot.current(spark, path))[0] == {(1, "swe", 0): 0.0, (2, "swe", 0): 5.0}
    put(spark, path, {(1, "depth"): 7, (3, "swe"): 9}, "new", merge=True)
    expected = {(1, "swe", 0): 0.0, (2, "swe", 0): 5.0, (1, "depth", 0): 7.0, (1, "depth", 1): 8.0, (3, "swe", 0): 9.0, (3, "swe", 1): 10.0}
    assert state(Snapshot.current(spark, path))[0] == expected
    for k in range(3):
        put(spark, path, {(2, "swe"): k}, f"n{k}", variables=["swe"])
    assert not (tmp_path / "observations/date=2020-01-02").exists() and not (tmp_path / "observations/date=2020-01-01").exists()
    assert state(Snapshot.current(spark, path))[0] == {**expected, (2, "swe", 0): 2.0, (2, "swe", 1): 3.0}


def test_only_chosen_dates_are_listed_and_none_is_empty(spark, tmp_path):
    from firnline.functions.dates import DateRange

    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        Snapshot.current(spark, path).observations()
    assert Snapshot.current(spark, path).manifest().count() == 0 and I.manifest_of(spark, path) is None
    put(spark, path, both(10, (1, 2, 3)), "a")
    snapshot = Snapshot.current(spark, path)
    two = snapshot.observations(DateRange(DAYS[1]))
    assert {r.date for r in two.collect()} == set(DAYS[1:]) and len({f.split("date=")[1][:10] for f in two.inputFiles()}) == 2
    assert snapshot.observations(DateRange(dt.date(2030, 1, 1))).columns == two.columns
    assert I.remove_date(spark, path, "2021-01-01") == [] and I.remove_date(spark, path, "2020-01-02", dry_run=True) == ["manifest", "observations"]
    assert I.remove_date(spark, path, "2020-01-02") == ["manifest", "observations"]
    assert {d for d, *_ in state(Snapshot.current(spark, path))[0]} == {1, 3}


def test_a_variable_keeps_its_type(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, both(10), "a")
    rows = spark.createDataFrame([(DAYS[2], "swe", 0, 0, 1.0)], LONG)
    plan = spark.createDataFrame([(DAYS[2], "v1:x", "write")], "date date, source_hash string, action string")
    with pytest.raises(SourceError, match="another type"):
        I.commit(rows, plan, ["swe"], path, types={"swe": "int"})


def test_each_variable_has_its_own_missing_value(spark):
    from firnline.functions.grid import Grid

    rows = spark.createDataFrame([("swe", DAYS[0], 0, [-1, 5, -9]), ("depth", DAYS[0], 0, [-1, -9, 7])], "product string, date date, row int, values array<int>")
    found = I.observations_of(rows, Grid(0.0, 0.0, 1.0, 3, 1, 4), {"swe": -1, "depth": -9})
    assert {(r.variable, r.pixel_id): r.value for r in found.collect()} == {("swe", 1): 5, ("swe", 2): -9, ("depth", 0): -1, ("depth", 2): 7}
