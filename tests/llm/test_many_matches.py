"""Texts with very many matches: the same spans as plain patterns give, block borders included."""

from __future__ import annotations

import re

from spanloom.llm import personal_data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_a_hundred_thousand_matches_in_one_text(spark):
    text = "".join(f"é user{i}@example{i % 7}.com\U0001d4b3, " for i in range(100_000))
    found = personal_data.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = ",".join(f"email:{m.start()}:{m.end()}" for m in EMAIL.finditer(text))
    assert found.n_email == 100_000 and found.spans == want


def test_blocks_of_matches_and_of_characters_meet_exactly(spark):
    m, c = personal_data.MATCHES, personal_data.CHARS
    texts = ["a@b.co " * n for n in (1, m - 1, m, m + 1, 2 * m, 2 * m + 1)]
    # The word nearby lies just inside or just outside the 40 characters, on either side of a block's border.
    texts += ["ü" * (at - 1) + " ssn" + "." * gap + "123-45-6789" for at in (c - 60, c - 3, c - 1, c, 2 * c - 20) for gap in (36, 37, 38)]
    texts += ["." * at + "123-45-6789" + "." * gap + "ssn" for at in (c - 60, c - 51, c - 11, c) for gap in (36, 37, 38)]
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert found[i].n_email == len(EMAIL.findall(text))
        ssn = re.search(r"123-45-6789", text)
        if ssn:
            around = text[max(0, ssn.start() - 40):ssn.end() + 40]
            assert found[i].n_ssn == int("ssn" in around), (i, text[-80:])
