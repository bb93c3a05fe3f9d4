import random
import time

import pytest

from quarry.llm import residue as module
from quarry.llm.residue import _Codes, _stripped, layout, residue, variable

PLACES = [a + b for a in ("Nor", "Tar", "Vel", "Jor", "Elm", "Gos") for b in ("by", "wick", "moor", "stead", "gard")]
NOUNS = [a + b for a in ("mill", "barn", "kiln", "dock", "shed") for b in ("", "s", "ery", "yard", "side", "land")]
NAMES = "first name,city,company,order ref,due date,phone".split(",")
NOTATIONS = ["{{%s}}", "{{ %s }}", "%%%s%%", "<%s>", "[%s]", "${%s}", "@@%s@@", "__%s__", "*|%s|*", "<%%= %s %%>", "&lt;%s&gt;", "[enter %s]", "(%s goes here)"]
FORMS = ["Dear %s, thank you for writing to %s about %s.", "The %s for %s was moved to %s.", "To: %s\nSubject: %s\n\nWe confirm %s as agreed."]
ERRORS = ["Error {n}", "Page not found.", "The {w} you asked for may have been deleted.", "Please try again in {n} minutes.", "Your session has expired.", "This {w} needs scripts to be shown."]
FURNITURE = ["Home | About | Contact", "Skip to main content", "All rights reserved."]
STOCK = ["Replace this paragraph with your own words.", "Nothing in here is final copy yet.", "More headings will be added at this place."]


def real(rng):
    return rng.choice(
        [
            f"Residents of {rng.choice(PLACES)} asked whether the {rng.choice(NOUNS)} had been closed.",
            f"We met in {rng.choice(PLACES)} about the {rng.choice(NOUNS)} and the {rng.choice(NOUNS)} on Friday.",
            f"Officials near {rng.choice(PLACES)} counted {rng.randrange(9000)} crates before the {rng.choice(NOUNS)} opened.",
        ]
    )


def a_variable(rng):
    name = rng.choice(NAMES)
    notation = rng.choice(NOTATIONS)
    return notation % (name if " " in notation.replace(" %s", "").replace("%s ", "") or notation[0] in "<[&" else name.replace(" ", "_"))


def corpus(seed=3):
    """(rows, ids of cases, ids of look-alikes)."""
    rng, rows, cases = random.Random(seed), {}, {}
    for i in range(600):
        rows[i] = " ".join(real(rng) for _ in range(rng.randrange(1, 6)))
    for i in range(1000, 1060):
        text = " ".join(rng.choice(FORMS) % tuple(a_variable(rng) for _ in range(3)) for _ in range(rng.randrange(1, 3)))
        rows[i], cases[i] = text, "placeholder"
    for i in range(1100, 1130):
        rows[i], cases[i] = f"{real(rng)} Residents of {a_variable(rng)} asked whether the {rng.choice(NOUNS)} had been closed.", "placeholder"
    for i in range(1200, 1260):
        body = "\n".join(rng.choice(ERRORS).format(n=rng.randrange(10, 99), w=rng.choice(["page", "site", "view"])) for _ in range(rng.randrange(1, 4)))
        rows[i], cases[i] = "\n".join([rng.choice(FURNITURE)] * rng.randrange(2) + [body] + [rng.choice(FURNITURE)] * rng.randrange(2)), "error page"
    for i in range(1300, 1330):
        rows[i], cases[i] = f"{real(rng)}\n\n{' '.join(rng.sample(STOCK, 3))}", "filler"
    pseudo = "lorem ipsum dolor amet velora porsit feugia rutrim sodalem pretios".split()
    for i in range(1400, 1420):
        rows[i], cases[i] = " ".join(" ".join(rng.choice(pseudo) for _ in range(8)).capitalize() + "." for _ in range(4)), "filler"
    quiet = {}
    for i in range(2000, 2010):
        quiet[i] = f'The guide of {rng.choice(PLACES)} explains that "{{{{{rng.choice(NAMES)}}}}}" in a mail is swapped for the value.'
    for i in range(2010, 2020):
        quiet[i] = f"The {rng.choice(NOUNS)} form of {rng.choice(PLACES)} lists fields [city], [phone] and [company], which all worked."
    for i in range(2020, 2030):
        quiet[i] = f"{rng.choice(FURNITURE)}\n{real(rng)} {real(rng)}\nThis site needs scripts to be shown."
    for i in range(2030, 2040):
        quiet[i] = f"Ann of {rng.choice(PLACES)} told why printers used lorem ipsum for the {rng.choice(NOUNS)} in May."
    quiet |= {2040: "", 2041: None, 2042: " \n\t", 2043: "...", 2044: 'Config: {"first_name": 4, "retries": 3} and it worked for the whole of our long summer party.'}
    return rows | quiet, cases, quiet


@pytest.fixture(scope="module")
def found(spark):
    rows, cases, quiet = corpus()
    df = spark.createDataFrame([(k, v, "x") for k, v in rows.items()] + [(1000, rows[1000], "y"), (None, rows[1001], "z")], "doc_id long, text string, reason string")
    return df, cases, quiet, residue(df, "doc_id", "text").collect()


def test_cases_are_found_without_any_list_of_wording(found):
    _, cases, quiet, got = found
    reasons = {r.doc_id: r.reason for r in got}
    for reason in ("placeholder", "error page", "filler"):
        wanted = {i for i, r in cases.items() if r == reason}
        assert len(wanted & set(reasons)) >= 0.9 * len(wanted), reason
    assert not set(reasons) & set(quiet)
    assert len([i for i in reasons if i is not None and i not in cases]) <= 6  # of 600
    assert sum(r.doc_id == 1000 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1


def test_joined_evidence_gives_the_same_result(found, monkeypatch):
    df, _, _, got = found
    monkeypatch.setattr(module, "MOST_BROADCAST", 0)
    monkeypatch.setattr(module, "STRIP_CHARS", 500)
    assert sorted(map(str, residue(df, "doc_id", "text").collect())) == sorted(map(str, got))


def test_a_tiny_filter_only_costs_time(found, monkeypatch):
    df, _, _, got = found
    whole = module._filter
    monkeypatch.setattr(module, "_filter", lambda codes: whole(codes, 15))
    assert sorted(map(str, residue(df, "doc_id", "text").collect())) == sorted(map(str, got))


def test_copies_change_nothing(found, spark):
    df, _, _, got = found
    copies = spark.createDataFrame([(9000 + i, "Residents of Norby asked whether the mill had been closed.", "c") for i in range(400)], df.schema)
    again = residue(df.unionByName(copies), "doc_id", "text").collect()
    assert {r.doc_id for r in again if (r.doc_id or 0) < 9000} >= {r.doc_id for r in got} - {None}


def test_an_empty_table_and_one_text(spark):
    df = spark.createDataFrame([(1, "Nothing else is known here.")], "doc_id long, text string")
    assert residue(df.limit(0), "doc_id", "text").count() == 0
    assert residue(df, "doc_id", "text").count() == 0


def test_variables():
    assert variable("{{ first_name }}") == ("{{", ["first", "name"], "}}", False)
    assert variable('"{{city}}"')[3]
    assert variable("<%= city %>")[:3] == ("<%=", ["city"], "%>")
    assert variable("&lt;due date&gt;")[1] == ["due", "date"]
    assert variable("*|CITY|*")[1] == ["city"]
    assert variable("[city)") is None


def test_names_are_one_token():
    page = layout(["Residents of Ann Mary Kordley asked Bo."], _Codes())
    assert (page.kind == module.NAMES).sum() == 1
    assert page.chars.sum() == len("ResidentsofAnnMaryKordleyaskedBo")


def test_very_long_texts_stay_linear(spark):
    import pandas as pd

    for text in ("{" * 100_000, "<a" * 50_000, "word " * 100_000, "[x" * 50_000, "." * 100_000, "_" * 100_000, "error 500 " * 3_000, "( " * 50_000, "a" * 200_000, "[a b c d " * 20_000):
        began = time.perf_counter()
        layout([text], _Codes())
        list(_stripped([pd.DataFrame({"c1": [1], "c2": [2], "text": [text]})]))
        assert time.perf_counter() - began < 5, text[:10]
