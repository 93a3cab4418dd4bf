"""Notes with versions seen: outcomes against a plain fold, writers that meet, deletion and compaction."""
import random

from lettergraph.operators.notes import EDITS, Notes
from lettergraph.shared import shared_path
from lettergraph.versions import Versions


def plain(edits, notes=None):
    """note: [version, last, body]; outcomes by (note, nr)."""
    notes, out = dict(notes or {}), {}
    for note, nr, seen, body in sorted(edits, key=lambda e: (e[0], e[1])):
        version, last, old = notes.get(note, (0, 0, None))
        text = (body or "").replace("\r\n", "\n").strip()
        if seen is not None and seen != version:
            came = "conflict"
        elif not text:
            came = "deleted" if version else "noop"
            version, old = 0, None
        else:
            came = "saved" if version else "created"
            if text != old:
                version = last = last + 1
                old = text
        notes[note] = (version, last, old)
        out[note, nr] = (came, version)
    return notes, out


def test_outcomes_are_those_of_one_edit_after_the_other(spark):
    r = random.Random(7)
    notes, store = {}, Notes(Versions(spark, shared_path(spark, "notes")))
    for round_ in range(3):
        edits = [(r.choice([1, 1, 1, 2, 3, 4]), round_ * 100 + k, r.choice([None, None, 0, 1, 2, 3]), r.choice([None, "", " \r\n", "a", "b", "b\r\n", "c\r\nd", "x" * 10_000])) for k in range(60)]
        notes, want = plain(edits, notes)
        got = {(x.note_id, x.nr): (x.outcome, x.version) for x in store.edit(spark.createDataFrame(edits, EDITS)).collect()}
        assert got == want
        assert {x.note_id: (x.version, x.body) for x in store.now().collect()} == {k: (v, b) for k, (v, _, b) in notes.items() if v}
    assert {o for o, _ in want.values()} == {"created", "saved", "deleted", "noop", "conflict"}


def test_a_note_that_came_back_is_another(spark):
    store = Notes(Versions(spark, shared_path(spark, "notes")))
    one = lambda nr, seen, body: store.edit(spark.createDataFrame([(1, nr, seen, body)], EDITS)).first()
    assert one(1, 0, "first").outcome == "created" and one(2, 1, "").outcome == "deleted" and one(3, 0, "second").version == 2
    assert one(4, 1, "over the first").outcome == "conflict" and one(5, 2, "second").version == 2
    one(6, None, "")
    assert store.now().isEmpty() and store.versions.read("notes").count() == 1
    store.compacted()
    assert store.versions.read("notes").isEmpty()


def test_writers_that_meet_try_again(spark):
    versions = Versions(spark, shared_path(spark, "notes"))
    store, commit, met = Notes(versions), versions.commit, []

    def late(*args, **options):
        if not met:
            met.append(1)
            Notes(Versions(spark, versions.root)).edit(spark.createDataFrame([(1, 1, 0, "theirs")], EDITS))
        return commit(*args, **options)

    versions.commit = late
    assert store.edit(spark.createDataFrame([(1, 2, 0, "mine")], EDITS)).first().outcome == "conflict"
    assert store.now().first().body == "theirs" and len(versions.numbers()) == 2


def test_nothing_and_nulls(spark):
    store = Notes(Versions(spark, shared_path(spark, "notes")))
    assert store.edit(spark.createDataFrame([], EDITS)).isEmpty() and store.now().isEmpty()
    assert store.edit(spark.createDataFrame([(None, 1, None, "x"), (1, None, None, "x"), (2, 1, None, None)], EDITS)).first().outcome == "noop"
