"""Tables with several writers: one row a key, whoever comes first."""

import random
import threading

import pytest

from moraine.sources.keyed import KeyedTable

SCHEMA = "lake_id long, day date, source string, scene_id long, area double"


def table(spark, tmp_path, **kw):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["lake_id", "day", "source"], order="scene_id", pruned="day", **kw)


def rows(spark, *found):
    return spark.createDataFrame([(lake, day, "s", scene, float(scene)) for lake, day, scene in found], "lake_id long, day string, source string, scene_id long, area double")


def read(t):
    return sorted((r["lake_id"], str(r["day"]), r["scene_id"]) for r in t.read().collect())


def test_append_is_idempotent_and_counts_its_own_write(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.version().number == -1
    first = t.append(rows(spark, (1, "2026-01-01", 7), (1, "2026-01-01", 5), (2, "2026-01-01", 1)))
    assert (first.version, first.rows, first.written.count()) == (0, 2, 2)
    again = t.append(rows(spark, (1, "2026-01-01", 3), (3, "2026-01-02", 9)))
    assert (again.version, again.rows) == (1, 1)
    assert read(t) == [(1, "2026-01-01", 5), (2, "2026-01-01", 1), (3, "2026-01-02", 9)]
    nothing = t.append(rows(spark, (3, "2026-01-02", 1)))
    assert (nothing.version, nothing.rows) == (1, 0)
    # an empty append, missing columns, null keys, other columns
    assert t.append(rows(spark)).rows == 0
    odd = spark.createDataFrame([(None, None, 4, "x"), (None, None, 3, "y")], "lake_id long, source string, scene_id long, other string")
    assert [t.append(odd).rows for _ in range(2)] == [1, 0]


def interleaved(spark, tmp_path, monkeypatch, first, second):
    """``second`` is appended after ``first`` was staged and before it claims its version."""
    t, other, done = table(spark, tmp_path), table(spark, tmp_path), []
    claim = KeyedTable._claim

    def late(self, number, folders):
        if self is t and not done:
            done.append(other.append(second))
        return claim(self, number, folders)

    monkeypatch.setattr(KeyedTable, "_claim", late)
    return t, t.append(first), done[0]


def test_two_interleaved_appends_leave_one_row_a_key(spark, tmp_path, monkeypatch):
    first, second = rows(spark, (1, "2026-01-01", 1), (2, "2026-01-01", 1)), rows(spark, (2, "2026-01-01", 2), (3, "2026-01-01", 2))
    t, mine, theirs = interleaved(spark, tmp_path, monkeypatch, first, second)
    assert read(t) == [(1, "2026-01-01", 1), (2, "2026-01-01", 2), (3, "2026-01-01", 2)]
    assert (theirs.version, theirs.rows, mine.version, mine.rows) == (0, 2, 1, 1)


def test_nothing_is_left_of_an_append_that_came_second(spark, tmp_path, monkeypatch):
    same = rows(spark, (1, "2026-01-01", 1))
    t, mine, _ = interleaved(spark, tmp_path, monkeypatch, same, same)
    assert (mine.version, mine.rows) == (0, 0) and read(t) == [(1, "2026-01-01", 1)]
    assert t.vacuum() == 0  # what it had staged is gone


def test_many_writers_at_once(spark, tmp_path):
    rng, failed = random.Random(4), []
    batches = [[(rng.randrange(8), f"2026-01-0{rng.randrange(1, 4)}", 100 * w + k) for k in range(12)] for w in range(5)]

    def run(batch):
        try:
            table(spark, tmp_path).append(rows(spark, *batch))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(b,)) for b in batches]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    found = read(table(spark, tmp_path))
    assert not failed and len(found) == len({x[:2] for x in found}) == len({x[:2] for b in batches for x in b})
    assert {x[2] for x in found} <= {x[2] for b in batches for x in b}


def test_a_dead_writer_and_compaction(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    for k in range(3):
        t.append(rows(spark, (k, "2026-01-01", k)))
    t._stage(rows(spark, (9, "2026-01-01", 9)))  # staged, never claimed
    assert len(read(t)) == 3
    old, done, claim = t.version(), [], KeyedTable._claim

    def late(self, number, folders):
        if not done:
            done.append(1)
            table(spark, tmp_path).append(rows(spark, (7, "2026-01-01", 7)))
        return claim(self, number, folders)

    monkeypatch.setattr(KeyedTable, "_claim", late)
    assert len(t.compact().folders) == 2 and len(read(t)) == 4 and t.read(old).count() == 3
    assert t.vacuum() == 4 and len(read(t)) == 4


def test_only_the_days_of_new_rows_are_read_again(spark, tmp_path, monkeypatch):
    t, seen = table(spark, tmp_path), []
    t.append(rows(spark, *((1, f"2026-01-{d:02d}", d) for d in range(1, 29))))
    near = KeyedTable._near
    monkeypatch.setattr(KeyedTable, "_near", lambda self, new, there: seen.append(near(self, new, there)) or seen[-1])
    t.append(rows(spark, (1, "2026-01-20", 1), (1, "2026-02-02", 1)))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert seen[0].count() == 9 and "GreaterThanOrEqual(day" in plan and "LessThanOrEqual(day" in plan
    with pytest.raises(Exception, match="day|cast|CAST"):
        t.append(rows(spark, (1, "no day", 1)))
    assert t.version().number == 1
