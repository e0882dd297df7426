"""An article that is marked up as several elements is given whole."""

from __future__ import annotations

from spanloom.llm import html_text


def test_dense_sibling_articles_are_kept():
    first, second = ("".join(f"<p>{word} part, sentence {k} with quite a few words in it.</p>" for k in range(9))
                     for word in ("first", "second"))
    links = "".join(f"<p><a href='{k}'>more {k}</a></p>" for k in range(5))
    text = html_text.main_text(f"<body><div><article>{first}</article><article>{second}</article>"
                               f"<article>{links}</article></div><div>{links}</div></body>")
    assert "first part, sentence 8" in text and "second part, sentence 8" in text and "more 1" not in text
