"""Problem 1: cut oversized texts at natural boundaries, with overlap.

A text's possible cuts and their strengths (paragraph over sentence over word) form an array
in text order.  A sparse table answers range-maximum queries over it in constant time: entry
[j][i] is the position of the strongest cut among the 2**j cuts from i on, the later one on a
tie.  From each piece's start the strongest cut in the permissible length window is asked for,
the rightmost among equals, and the next piece starts the overlap before it.  Where that window has
none as strong as the text allows, every cut beyond the overlap is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("none", "word", "sentence", "paragraph")
WORD, SENTENCE, PARAGRAPH = 1, 2, 3

#: A blank line is a line of blanks or tabs; a line end is LF or CRLF.
_PARAGRAPH = re.compile(r"(?:\A|\r?\n)(?:[ \t]*\r?\n)+|\r?\n[ \t]*\Z")
#: Sentence marks, and the closing quotes and brackets that may follow them.
_SENTENCE = re.compile("(?<![.!?…])[.!?…]++[\"'”’»›“‘)\\]}」』）】〉》]*+(\\s++)|。")
_SPACE = re.compile(r"\s+")


def _separators(text: str) -> list[tuple[int, int, int]]:
    """(start, end, strength) of every separator, in text order and disjoint; 。 has no width."""
    found: dict[int, tuple[int, int]] = {}
    for m in _SPACE.finditer(text):
        found[m.start()] = (m.end(), WORD)
    for m in _SENTENCE.finditer(text):
        if m.group(1) is not None:
            found[m.start(1)] = (m.end(1), SENTENCE)
        elif m.end() not in found:
            found[m.end()] = (m.end(), SENTENCE)
        else:
            found[m.end()] = (found[m.end()][0], SENTENCE)
    for m in _PARAGRAPH.finditer(text):
        inside = m.start()
        run = _SPACE.match(text, inside)
        # Blanks before the line end belong to the same run of white space.
        while inside > 0 and text[inside - 1].isspace():
            inside -= 1
        end = run.end() if run else m.end()
        if inside in found:
            found[inside] = (max(found[inside][0], end), PARAGRAPH)
        else:
            found[inside] = (end, PARAGRAPH)
    return [(s, e, k) for s, (e, k) in sorted(found.items())]


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    spans, at = [], 0
    for m in re.finditer(r"(?:\A(?:[ \t]*\r?\n)+)|(?:\r?\n(?:[ \t]*\r?\n)+)", text):
        if m.start() > at:
            spans.append((at, m.start()))
        at = m.end()
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def coarsest_fitting_unit(text: str, limit: int) -> str:
    """The coarsest unit of which no instance in the text exceeds ``limit`` characters."""
    paragraphs = paragraph_spans(text)
    if all(e - s <= limit for s, e in paragraphs):
        return "paragraph"
    longest_sentence = 0
    for s, e in paragraphs:
        at = s
        for m in _SENTENCE.finditer(text, s, e):
            end = m.start(1) if m.group(1) is not None else m.end()
            longest_sentence = max(longest_sentence, end - at)
            at = m.end()
        longest_sentence = max(longest_sentence, e - at)
    if longest_sentence <= limit:
        return "sentence"
    at = longest_word = 0
    for m in _SPACE.finditer(text):
        longest_word = max(longest_word, m.start() - at)
        at = m.end()
    return "word" if max(longest_word, len(text) - at) <= limit else "none"


class CutIndex:
    """Sparse table over the strengths of a text's cuts; a cut is the end of a separator."""

    def __init__(self, text: str):
        cuts = [(e, k) for _, e, k in _separators(text) if 0 < e < len(text)]
        self.at = np.array([c for c, _ in cuts], dtype=np.int64)
        self.strength = np.array([k for _, k in cuts], dtype=np.int8)
        self.rows = [np.arange(len(cuts), dtype=np.int64)]
        width = 1
        while 2 * width <= len(cuts):
            last = self.rows[-1]
            left, right = last[:-width], last[width:]
            self.rows.append(np.where(self.strength[right] >= self.strength[left], right, left))
            width *= 2

    def strongest(self, low: int, high: int) -> tuple[int, int]:
        """(position, strength) of the strongest cut in [low, high], the rightmost of equals; (-1, 0) if there is none."""
        a, b = int(np.searchsorted(self.at, low, "left")), int(np.searchsorted(self.at, high, "right"))
        if a >= b:
            return -1, 0
        j = (b - a).bit_length() - 1
        left, right = self.rows[j][a], self.rows[j][b - (1 << j)]
        best = int(right if self.strength[right] >= self.strength[left] else left)
        return int(self.at[best]), int(self.strength[best])


def split_text(text: str, limit: int, overlap: int, least: int, wanted: int = WORD) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at end) of the pieces of one text; the last has strength PARAGRAPH.

    A cut weaker than ``wanted`` is taken only if no stronger one lies anywhere beyond the overlap.
    """
    pieces, start, index = [], 0, CutIndex(text)
    while len(text) - start > limit:
        cut, strength = index.strongest(start + least, start + limit)
        if strength < wanted:
            earlier, stronger = index.strongest(start + overlap + 1, start + limit)
            if stronger > strength:
                cut, strength = earlier, stronger
        if cut < 0:
            cut, strength = start + limit, 0
        pieces.append((start, cut, strength))
        start = cut - overlap
    pieces.append((start, len(text), PARAGRAPH))
    return pieces


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 6000, overlap: int = 300, least: int | None = None) -> DataFrame:
    """(key, piece, piece_start, piece_end, cut, boundary, piece_text): the pieces of every text longer than ``limit`` characters.

    Pieces hold at most ``limit`` characters; each but the first begins exactly ``overlap``
    characters before the end of the one before, so dropping the first ``overlap`` characters of
    all later pieces and joining gives the text back.  A piece is cut at the strongest boundary
    between ``least`` (half the limit unless given) and ``limit`` characters, the rightmost of
    equals; if that is weaker than ``boundary``, or there is none, at the strongest beyond the
    overlap; and after exactly ``limit`` characters where that has none either.  ``cut`` names the
    boundary at the piece's end, ``boundary`` the coarsest unit of which no instance in the whole
    text exceeds the limit.  Texts that are null, empty or within the limit give no row.  Repeated
    rows come out repeatedly: bring one row per key.  Null keys pass through.  Other columns are
    ignored, whatever their names.  Each text is cut on its own; nothing is shuffled.
    """
    if not 0 <= overlap < (least if least is not None else limit // 2) <= limit:
        raise ValueError("need 0 <= overlap < least <= limit")
    low = limit // 2 if least is None else least
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch["k"], batch["t"]):
                boundary = coarsest_fitting_unit(t, limit)
                for i, (s, e, strength) in enumerate(split_text(t, limit, overlap, low, max(WORD, LEVELS.index(boundary)))):
                    out.append((k, i, s, e, "end" if e == len(t) else LEVELS[strength], boundary, t[s:e]))
            yield pd.DataFrame(out, columns=["k", "piece", "piece_start", "piece_end", "cut", "boundary", "piece_text"])

    oversized = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter(F.length("t") > limit)
    pieces = oversized.mapInPandas(cut, f"k {kind}, piece int, piece_start long, piece_end long, cut string, boundary string, piece_text string")
    return pieces.withColumnRenamed("k", key)
