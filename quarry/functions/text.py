"""Text functions: terms, folding, stemming, canonical forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a content query ignores.
STOPWORDS = (
    "the and for are was were what when where who whom which how why did does do is of to in on at by an a it "
    "its this that these those with from as be or if about into over than then they them their you your we our i"
).split()


def terms(text: Column) -> Column:
    """All runs of ASCII letters and digits, lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with diacritics and their bases, and combining marks, which have none."""
    letters = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)])]
    plain = [(c, d[0]) for c, d in letters if len(d) > 1 and d[0].isascii() and d[0].islower() and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in plain) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in plain)


def folded_terms(text: Column) -> Column:
    """Terms of the text without diacritics; folding is a character table, so no Python runs."""
    return F.regexp_extract_all(F.translate(F.lower(text), *_folding()), F.lit("([a-z0-9]+)"), F.lit(1))


def content_terms(query: str) -> list[str]:
    """Terms a query asks for: at least three UTF-8 bytes, no stopword, first occurrence only.

    A query of stopwords and short tokens alone asks for its blank-separated tokens instead.
    """
    words = re.findall(r"[^\W_]+", query.lower())
    content = [w for w in words if len(w.encode()) >= 3 and w not in STOPWORDS]
    return list(dict.fromkeys(content or query.split()))


def match_expression(query: str) -> str:
    """The terms as quoted literals joined by OR; control syntax can't survive."""
    return " OR ".join('"' + t.replace('"', '""') + '"' for t in content_terms(query))


def fold_text(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def canonical(text: str | None) -> str:
    """Surface form for matching: compatibility decomposition without marks, single blanks, case folded."""
    if not text:
        return ""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(bare.split()).casefold()


def canonical_relation(text: str | None) -> str:
    return re.sub(r"[\s-]+", "_", canonical(text))


def arrow_map(function, returns: str = "string"):
    """A one-argument Python function as an Arrow function that computes each distinct value of a batch once."""

    @F.pandas_udf(returns)
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = {v: function(v) for v in batch.dropna().unique()}
            yield batch.map(known)

    return mapped


def folded(text: Column) -> Column:
    return arrow_map(fold_text)(text)


def canon(text: Column) -> Column:
    return F.coalesce(arrow_map(canonical)(text), F.lit(""))


def stemmed(term: Column) -> Column:
    """Porter stem of folded terms; use it on a table of distinct terms."""
    return arrow_map(lambda t: porter(fold_text(t)))(term)


def squad_tokens(text: Column) -> Column:
    """Answer tokens: lower case, ASCII letters and digits, articles dropped."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " ")
    return F.filter(F.split(plain, " +"), lambda t: (t != "") & ~t.isin("a", "an", "the"))


# The published Porter algorithm (1980), written over a measure of vowel-consonant changes.
def _shape(word: str) -> str:
    out = []
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _ends_cvc(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


# Suffixes and what replaces them, in the order tried.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _ends_cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEP2, _STEP3):
        hit = max((s for s in steps if w.endswith(s[0])), key=lambda s: len(s[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    end = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if end:
        stem = w[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
