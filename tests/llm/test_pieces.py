import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barrow.llm import pieces

TEXTS = st.text(alphabet=st.sampled_from("аб я.!?\n\t«»1 "), max_size=400)


def whole(text, spans):
    out = ""
    for a, b in spans:
        assert a <= len(out) and b > len(out)
        out += text[len(out) : b]
    return out


def by_ranges(text, limit, overlap, size):
    """The pieces of a text through ranges of `size` characters, as the operators stitch them."""
    left = overlap + pieces.RUN + pieces.HALO
    chains = []
    for at in range(0, len(text), size):
        begin = max(0, at - left)
        view = text[begin : at + size + limit + 1]
        chains.append((min(size, len(text) - at), pieces.Chain(view, at - begin, at + size + limit + 1 >= len(text), limit, overlap)))
    out = []
    for no, offset, entry, before in pieces.stitched((k, *pieces._summary(c, n, k == 0)) for k, (n, c) in enumerate(chains)):
        assert before == len(out)
        n, chain = chains[no]
        out += [(offset + a, offset + b) for a, b in chain.walk(None if no == 0 else entry, n)]
    return out


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(10, 60), st.integers(0, 4), st.integers(0, 90))
def test_pieces_cover_fit_and_do_not_depend_on_ranges(text, limit, overlap, more):
    spans = pieces.split_text(text, limit, overlap)
    assert spans == by_ranges(text, limit, overlap, limit + overlap + more)
    assert all(0 < b - a <= limit for a, b in spans)
    assert whole(text, spans) == text
    assert all(nxt[0] >= cur[1] - overlap for cur, nxt in zip(spans, spans[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400), st.integers(0, 400), st.integers(0, 400), st.sampled_from([" ", "\n", "x", " \n"]), st.integers(50, 200))
def test_long_words_and_long_runs_of_space(a, b, c, fill, size):
    text = "х" * a + fill * b + "Ы. " + "я" * c + fill * a + "\n"
    assert pieces.split_text(text, 40, 8) == by_ranges(text, 40, 8, size)


def test_prefers_paragraph_then_sentence_then_word():
    text = "Один два. " * 6 + "\n\n" + "Три четыре пять шесть. " * 10
    first = pieces.split_text(text, 100, 10)[0]
    assert text[: first[1]].endswith("\n\n")
    words = "слово " * 100
    assert all(words[:b].endswith(" ") for _, b in pieces.split_text(words, 100, 10)[:-1])
    assert pieces.split_text("x" * 250, 100, 20) == [(0, 100), (80, 180), (160, 250)]


def test_initials_end_no_sentence():
    assert not pieces._ends_sentence("Отчёт Иванова И.", "П") and not pieces._ends_sentence("в 2013 г.", "з") and pieces._ends_sentence("находок нет.", "С")


def test_column(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "коротко", "x"), (4, "слово " * 900, "x"), (4, "слово " * 900, "x"), (None, "слово " * 600, "x")], "id int, text string, piece string")
    got = pieces.split_column(df, ["id"], "text").toPandas()
    assert sorted(got["piece_no"][got["id"].isna()]) == [1, 2]
    assert got[got["id"] == 3]["piece"].tolist() == ["коротко"] and (got["id"] == 2).sum() == 0
    four = got[got["id"] == 4]
    assert len(four) == 4 and (four["piece"].str.len() == four["end"] - four["start"]).all() and four["n_chars"].eq(5400).all()
    assert pieces.split_column(df.limit(0), ["id"], "text").count() == 0
    with pytest.raises(ValueError):
        pieces.split_column(df, ["id"], "text", 100, 60)


def long_text(n, seed=3):
    draw = np.random.default_rng(seed)
    return "".join(draw.choice(["слово ", "щебёнка. ", "\n\n", "x", "😀 ", "длинноеслово", "Конец.\n", " \u2003 "], n))


def test_texts_of_many_ranges_are_cut_as_in_one(spark):
    texts = [long_text(4000), "x" * 30000, long_text(4000), " " * 9000, long_text(50, 5)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "id int, text string")
    got = pieces.split_column(df, ["id"], "text", 300, 30, 700).toPandas()
    for i, text in enumerate(texts):
        own = got[got["id"] == i].sort_values(["piece_no"]).drop_duplicates()
        want = pieces.split_text(text, 300, 30)
        assert own["piece_no"].tolist() == list(range(1, len(want) + 1))
        assert list(zip(own["start"], own["end"], strict=True)) == want and own["piece"].tolist() == [text[a:b] for a, b in want]
    assert (got["id"] == 0).sum() == 2 * len(pieces.split_text(texts[0], 300, 30))


@pytest.mark.parametrize("size", [2100, 4096, 9973])
def test_files_by_byte_ranges_are_cut_as_in_one(spark, tmp_path, size):
    texts = {"a.txt": long_text(9000), "b.txt": "😀" * 5000 + "\n\n" + "ж" * 700, "empty.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    raw = "слово ".encode() * 900 + bytes([0x80] * 40 + [0xC3, 0xE2, 0x82, 32, 0xFF] * 400) + "конец. ".encode() * 300
    (tmp_path / "raw.txt").write_bytes(raw)
    texts["raw.txt"] = raw.decode("utf-8", "replace")
    files = spark.createDataFrame([(str(p), os.path.getsize(p)) for p in tmp_path.iterdir()], "path string, bytes long")
    got = pieces.split_files(spark, files, limit=500, overlap=20, size=size).toPandas()
    for name, text in texts.items():
        own = got[got["path"] == str(tmp_path / name)].sort_values("piece_no")
        want = pieces.split_text(text, 500, 20)
        assert list(zip(own["start"], own["end"], strict=True)) == want
        assert own["piece"].tolist() == [text[a:b] for a, b in want] and own["piece_no"].tolist() == list(range(1, len(want) + 1))
