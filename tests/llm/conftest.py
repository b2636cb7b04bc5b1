from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, _id int, band double, words string, at int, _key_of_text long, _gone string, row int, gone int"


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in all columns, empty, blank and long texts, exact and near copies, repeated rows, ties, odd characters."""
    rng = random.Random(5)
    base, passage = _words(rng, 300), _words(rng, 70)
    edited = base.split()
    edited[40] = "zzz"
    # two words of equal hash under any polynomial in an odd base modulo a power of two, and two runs of words so
    turns = [bin(k).count("1") % 2 for k in range(2048)]
    alike = ["".join("ab"[t ^ flip] for t in turns) for flip in (0, 1)]
    runs = [" ".join(("left", "right")[t ^ flip] for t in turns) for flip in (0, 1)]
    rest = _words(rng, 59)
    texts = {
        1: base, 2: base, 3: " ".join(edited), 4: base.upper(), 5: None, 6: "", 7: " \n\t ", 8: "one two", 9: "One two", 10: "x" * 5000,
        11: _words(rng, 60) + " " + passage + "\n" + _words(rng, 30), 12: _words(rng, 40) + "\n" + passage + " " + _words(rng, 20),
        13: "a  b \n\n c\r\n d\x0b\x0ce", 14: "don't stop İstanbul ß 中文 😀 <|endoftext|> \x1c x", 15: "a " * 400, 16: _words(rng, 20_000),
        20: f"{rest} {alike[0]}", 21: f"{rest} {alike[1]}", 22: runs[0], 23: runs[1],
        17: "A line that is just long enough, really.\nother", 18: "A line that is just long enogh, really.\nmore", 19: "\n".join(["same line of text here"] * 5),
    }
    rows = [(k, t, "en" if k % 2 else "de", f"s{k % 3}", len(t or ""), "n", k, 0.5, "w", k, -k, "g", k, k) for k, t in texts.items()]
    rows += [rows[0], rows[10], (None, base, *[None] * 12), (None,) * 14]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
