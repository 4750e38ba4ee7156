"""Racing writers, crashes and readers of the revision store."""

import json
import threading

import pytest

from kinspan.schema import archive_type
from kinspan.sources.revisions import Revisions, StaleCases


def documents(spark, texts):
    rows = [json.dumps({"meta": {"id": c, "owner_name": t}, "revision": 0, "utterances": [{"id": "u1", "seq": 1, "text": t}]}) for c, t in texts.items()]
    return spark.read.schema(archive_type()).json(spark.sparkContext.parallelize(rows, 1))


def state(store):
    return {(r["case_id"], r["revision"]): json.loads(r["document"])["meta"]["owner_name"] for r in store.all().collect()}


def test_only_changes_make_revisions(spark, tmp_path):
    empty = Revisions(spark, str(tmp_path))
    assert empty.version == 0 and empty.all().isEmpty() and empty.save(documents(spark, {})) is empty
    one = empty.save(documents(spark, {"a": "x", "b": "y"}))
    two = one.save(documents(spark, {"a": "x", "b": "z"}))
    assert two.save(documents(spark, {"a": "x"})) is two
    assert state(two) == {("a", 1): "x", ("b", 1): "y", ("b", 2): "z"} and state(one) == {("a", 1): "x", ("b", 1): "y"}
    assert {(r["case_id"], r["revision"]) for r in two.current().collect()} == {("a", 1), ("b", 2)}
    docs = {r["meta"]["id"]: r for r in two.archives(archive_type()).collect()}
    assert docs["b"]["revision"] == 2 and docs["b"]["utterances"][0]["text"] == "z"


def test_stale_save_is_refused_and_other_cases_go_on(spark, tmp_path):
    start = Revisions(spark, str(tmp_path)).save(documents(spark, {"a": "0", "b": "0"}))
    start.save(documents(spark, {"a": "1"}))
    with pytest.raises(StaleCases, match="a"):
        start.save(documents(spark, {"a": "2", "b": "2"}))
    last = start.save(documents(spark, {"b": "3", "c": "3"}))  # the same snapshot, but nobody touched b
    assert state(last) == {("a", 1): "0", ("a", 2): "1", ("b", 1): "0", ("b", 2): "3", ("c", 1): "3"}
    assert last.orphans() == []


def test_racing_writers_lose_nothing(spark, tmp_path):
    start = Revisions(spark, str(tmp_path)).save(documents(spark, {"shared": "0"}))
    won, errors = [], []

    def write(who):
        try:
            for i in range(3):
                Revisions(spark, str(tmp_path)).save(documents(spark, {who: str(i)}))
                while True:
                    now = Revisions(spark, str(tmp_path))
                    before = now.current().where("case_id = 'shared'").first()
                    try:
                        now.save(documents(spark, {"shared": f"{who}{i}"}))
                        won.append((before["revision"] + 1, f"{who}{i}"))
                        break
                    except StaleCases:
                        pass
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in "pq"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    end = Revisions(spark, str(tmp_path))
    assert state(end) == {("shared", 1): "0", **{("shared", n): t for n, t in won}, **{(w, i + 1): str(i) for w in "pq" for i in range(3)}}
    assert sorted(n for n, _ in won) == list(range(2, 8)) and end.version == start.version + 12


def test_a_crash_before_the_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    start = Revisions(spark, str(tmp_path)).save(documents(spark, {"a": "0"}))
    monkeypatch.setattr(Revisions, "_commit", lambda self, live: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        start.save(documents(spark, {"a": "1"}))
    monkeypatch.undo()
    again = Revisions(spark, str(tmp_path))
    assert state(again) == {("a", 1): "0"} and len(again.orphans()) == 1
    assert state(again.save(documents(spark, {"a": "1"}))) == {("a", 1): "0", ("a", 2): "1"}


def test_prune_keeps_the_newest_and_saves_meanwhile(spark, tmp_path):
    store = Revisions(spark, str(tmp_path))
    for i in range(4):
        store = store.save(documents(spark, {"a": str(i), "b": "0"}))
    store.save(documents(spark, {"c": "new"}))
    small = store.prune(2)
    assert state(small) == {("a", 3): "2", ("a", 4): "3", ("b", 1): "0", ("c", 1): "new"} and len(small.batches) == 2
    assert small.save(documents(spark, {"a": "5"})).current().where("case_id = 'a'").first()["revision"] == 5
    with pytest.raises(StaleCases):
        store.prune(1)
