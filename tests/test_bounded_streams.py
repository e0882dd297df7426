"""A batch of a stream waits in Python folded, or as Arrow columns, not as objects of all its rows."""

from __future__ import annotations

import random

import pandas as pd
import pyarrow as pa

from spanloom.streaming import closing
from spanloom.streaming.identity import frames_in_order


def test_rows_fold_while_they_come(monkeypatch):
    monkeypatch.setattr(closing, "FOLD_ROWS", 100)
    rng = random.Random(3)
    rows = [(rng.choice(["p", "q"]), f, f, f + 20, f + 20, None) for f in (rng.randrange(400) for _ in range(6000))]
    whole = pd.DataFrame(rows, columns=closing.OPEN)
    gathered, most = closing.Gathered(), 0
    for begin in range(0, len(rows), 50):
        gathered.add(whole.iloc[begin : begin + 50])
        most = max(most, gathered.waiting + (0 if gathered.held is None else len(gathered.held)))
    got = pd.concat(list(gathered.named(gathered.fold())))
    want = closing.merged(whole)
    assert sorted(zip(got["label"], got["first"], got["last"])) == sorted(zip(want["label"], want["first"], want["last"]))
    assert most <= 250


def test_frames_come_in_order_of_an_unordered_batch():
    rng = random.Random(4)
    rows = [(rng.randrange(300), o, rng.choice(["new", "7", None]), rng.choice("ab"), [o % 5] * (o % 3)) for o in range(25_000)]
    shape = pa.schema([("frame", pa.int64()), ("ordinal", pa.int32()), ("raw_id", pa.dictionary(pa.int32(), pa.string())),
                       ("cls", pa.dictionary(pa.int32(), pa.string())), ("blocks", pa.list_(pa.int32()))])
    frame = pd.DataFrame(rows, columns=shape.names)
    got = frames_in_order((frame.iloc[b : b + 4000] for b in range(0, len(rows), 4000)), shape)
    assert [(f, *o) for f, objects in got for o in objects] == sorted(rows, key=lambda r: r[:2])
