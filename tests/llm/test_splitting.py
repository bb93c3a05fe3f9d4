import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.splitting import CutIndex, coarsest_fitting_unit, split_oversized, split_text


def brute_strongest(index, low, high):
    best = (-1, 0)
    for at, k in zip(index.at.tolist(), index.strength.tolist()):
        if low <= at <= high and k >= best[1]:
            best = (at, k)
    return best


def text_of(seed, n=4000):
    rnd = random.Random(seed)
    return "".join(rnd.choice(["word ", "end. ", "x\n\n", "line\n", "日本。", "\r\n \r\nnext", "abc", "Quote.\" ", "…) "]) for _ in range(n))


def test_index_answers_like_a_scan():
    for seed in range(5):
        index = CutIndex(text_of(seed, 300))
        rnd = random.Random(seed)
        for _ in range(200):
            low = rnd.randrange(1500)
            high = low + rnd.randrange(400)
            assert index.strongest(low, high) == brute_strongest(index, low, high)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\r!。\"", max_size=300), st.integers(6, 40))
def test_pieces_round_trip(text, limit):
    overlap = limit // 6
    pieces = split_text(text, limit, overlap, limit // 2)
    assert all(e - s <= limit for s, e, _ in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b[0] == a[1] - overlap for a, b in zip(pieces, pieces[1:]))
    assert text[: pieces[0][1]] + "".join(text[s + overlap : e] for s, e, _ in pieces[1:]) == text


def test_units():
    assert coarsest_fitting_unit("aaaa\n\nbbbb", 5) == "paragraph"
    assert coarsest_fitting_unit("aaaa\r\n \t\r\nbbbb", 5) == "paragraph"
    assert coarsest_fitting_unit("aaaa\nbbbb", 5) == "word"  # a single line break splits no paragraph
    assert coarsest_fitting_unit("Aa a. Bb b.", 6) == "sentence"
    assert coarsest_fitting_unit("日本語。日本語。", 4) == "sentence"
    assert coarsest_fitting_unit("aa bb cc", 3) == "word"
    assert coarsest_fitting_unit("a" * 10, 6) == "none"
    assert coarsest_fitting_unit("x.)\" y", 4) == "sentence"


def test_long_runs_stay_linear():
    for run in ("." * 200_000, " " * 200_000, "\n" * 200_000, "a" * 200_000, ".\"" * 100_000):
        pieces = split_text(run, 6000, 300, 3000)
        assert pieces[-1][1] == len(run)
        coarsest_fitting_unit(run, 6000)


def test_operator_edges(spark):
    rows = [("long", "w " * 50, "k"), (None, "y" * 100, "k"), ("null", None, "k"), ("empty", "", "k"), ("short", "abc", "k"), ("long", "w " * 50, "k")]
    df = spark.createDataFrame(rows, "id string, body string, piece string")
    got = split_oversized(df, "id", "body", 40, 5).collect()
    assert {r.id for r in got} == {"long", None}
    assert sum(r.id == "long" and r.piece == 0 for r in got) == 2
    assert all(len(r.piece_text) <= 40 and r.piece_text == ("w " * 50 if r.id else "y" * 100)[r.piece_start : r.piece_end] for r in got)
    assert {r.boundary for r in got if r.id is None} == {"none"}
    assert split_oversized(df.limit(0), "id", "body", 40, 5).count() == 0


def test_no_hard_cut_where_an_earlier_boundary_lies(spark):
    text = "a" * 10 + " " + "b" * 45
    assert split_text(text, 40, 5, 20)[0] == (0, 11, 1)
    two = "A" * 14 + "\n\n" + "b c " * 6 + "\n\n" + "d" * 20
    (first, *_) = split_oversized(spark.createDataFrame([(1, two)], "id int, body string"), "id", "body", 40, 5).orderBy("piece").collect()
    assert (first.boundary, first.cut, first.piece_end) == ("paragraph", "paragraph", 16)
