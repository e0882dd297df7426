"""Scans of frames hold one frame at a time, and match without going through all known objects."""

from __future__ import annotations

import random

import pyarrow as pa

from spanloom.operators import identity


def plain_match(cls, blocks, free):
    """The rule as it is written: the first whose blocks meet or are unknown, else the first of the class."""
    fallback = None
    for known, (known_class, known_blocks) in free.items():
        if known_class == cls:
            if not blocks or not known_blocks or blocks & known_blocks:
                return known
            fallback = known if fallback is None else fallback
    return fallback


def test_free_objects_are_found_by_the_rule():
    rng = random.Random(5)

    def blocks():
        return rng.sample(range(4), rng.randrange(3))

    for _ in range(300):
        context = [(rng.randrange(12), rng.choice("ab"), blocks()) for _ in range(rng.randrange(15))]
        free, plain = identity.Free(context), {i: (c, set(b)) for i, c, b in context}
        for _ in range(15):
            if rng.random() < 0.3:
                given = rng.randrange(12)
                free.drop(given)
                plain.pop(given, None)
            cls, asked = rng.choice("abc"), blocks()
            want = plain_match(cls, set(asked), plain)
            plain.pop(want, None)
            assert free.take(cls, asked) == want


def test_a_crowded_frame_takes_no_square_of_its_objects():
    """Each new object once went through all objects known of other classes and blocks."""

    class Counted(str):
        met = 0

        def __ne__(self, other):
            Counted.met += 1
            return str.__ne__(self, other)

        __eq__, __hash__ = str.__eq__, str.__hash__

    context = [(i, Counted("a"), [1]) for i in range(3000)]
    out = identity.resolve_frame([(o, "new", Counted("b"), [1]) for o in range(3000)], context)
    assert len(out) == 3000 and all(i is None for _, i in out) and Counted.met < 30_000


def test_a_tracker_keeps_what_a_context_can_hold():
    tracker = identity.Tracker(3, 1, 30)
    tracker.step(1, [(o, "new", "a", []) for o in range(1000)])
    assert len(tracker.recent[0][1]) == 30
    assert tracker.context(2) == [(i, "a", []) for i in range(1, 31)]


def test_frames_span_batches():
    rows = [("x", 1, 0), ("x", 1, 1), ("x", 2, 2), ("y", 2, 3), ("y", 2, 4), ("y", 3, 5)]
    table = pa.table(dict(zip(("analysis_id", "frame", "ordinal"), map(list, zip(*rows)))))
    for size in (1, 2, 4, 6):
        got = identity.frames_of(iter(table.to_batches(max_chunksize=size)), lambda b: b.column("ordinal").to_pylist())
        assert list(got) == [("x", 1, [0, 1]), ("x", 2, [2]), ("y", 2, [3, 4]), ("y", 3, [5])]
