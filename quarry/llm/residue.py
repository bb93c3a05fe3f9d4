"""Problem 8: documents in which template residue, filler or an error page stands in place of content.

Records made from one template say the same words around the places where they differ.  Those places are
induced from the whole corpus.  A *hole* is a word's surrounding, the two words before it and the one after
it, names and numbers masked.  A hole is an open slot if records fill it with many different words, or if the
next record would likely fill it with a new one (at least half of its fillings were seen once).  A word that has a
fifth of a slot's fillings for itself doesn't fill it: it belongs to a template of its own there.

* Placeholders.  A variable name is a name that comes in several notations, a notation is a pair of brackets
  that holds several such names; both are learned from the corpus, no notation is listed.  Where aligned records
  have ordinary words, or variables in several notations, the place is a slot, and a record that retains a
  variable, a default or a blank there is residue.  A place that mostly holds one notation, in texts that differ
  by more than names and numbers, is a sentence about placeholders; quoted ones are no residue either.
* Templates of whole pages.  Content fills open slots; error pages, script notices, page furniture and stock
  filler fill none.  Sentences, lines and fragments without an open slot are collected, and what of them comes
  back word for word in several texts is template.  A page that is template as a whole is residue, and so is a
  text that is template by about half.  No wording decides.
* Pseudo-text has no template.  Its words are learned from the sentences with two of its seed words.

Texts count once, however many copies there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut

#: Up to so many open holes or repeated word triples go to every task, 8 bytes each; more of them are joined.
MOST_BROADCAST = 4_000_000
#: Bits of the filter that tells which surroundings are worth counting; what passes is joined exactly.
FILTER_BITS = 26
#: Characters of texts laid out together by a task.
STRIP_CHARS = 1_000_000
#: Surroundings and fillings a task counts together before it passes them on.
MOST_HELD = 2_000_000

# Seed words of pseudo-text.
SEEDS = ("lorem", "ipsum", "dolor", "amet")
# What is left where a value is missing and no variable name is: blanks, formats, null values.
DEFAULTS = r"_{3,}|\bX{4,}\b|%s|\bnull\b|\bNone\b|\bundefined\b|\bNaN\b|\[object Object\]|\{\d\}"
# Elements of the markup language, whose tags end a line.
_TAG = r"</?(?:html|head|title|body|main|div|span|p|h[1-6]|br|hr|a|b|i|em|strong|ul|ol|li|noscript|script|style|pre|code|table|tr|td|th|img|section|article|center)\b[^<>]{0,80}>"
_JSON = r"\{\s*\"\w+\"\s*:|\"\s*[,:]\s*\"|\"\s*\}"
_QUOTE = "[\"'`“”„]"
_SYMBOL = r"[^\w\s.,;:!?'\"…。“”„`|/\\+=&~-]"
_OPEN, _CLOSE = rf"(?<!\w)(?:&lt;|__|\*\||{_SYMBOL}{{1,3}}=?)", rf"(?:&gt;|__|\|\*|{_SYMBOL}{{1,3}})(?!\w)"
_INNER = r"[^\W\d_][\w.-]{0,40}?(?: {1,2}[\w.-]{1,40}?){0,5}?"
_SPAN = rf"{_OPEN} ?{_INNER} ?{_CLOSE}"
_CHARACTER = "[぀-ヿ㐀-鿿]"  # of scripts without blanks between words
_WORD = r"[^\W_぀-ヿ㐀-鿿]+(?:['’-][^\W_぀-ヿ㐀-鿿]+)*"
_STOPS = r"[.!?…。]+(?=\s|$)|。|[\r\n\x0b\x0c\u2028\u2029]+|\s\|\s"
_TOKEN = re.compile(rf"{_TAG}|{_QUOTE}?(?:{DEFAULTS}){_QUOTE}?|{_QUOTE}?{_SPAN}{_QUOTE}?|{_JSON}|{_STOPS}|{_CHARACTER}|{_WORD}")
_SIMPLE = re.compile(rf"{_WORD}|{_STOPS}|{_CHARACTER}")
_LEFT_OUT = re.compile(rf"{_QUOTE}?(?:{DEFAULTS}){_QUOTE}?")
_VARIABLE = re.compile(rf"({_QUOTE}?)({_OPEN}) ?({_INNER}) ?({_CLOSE})({_QUOTE}?)")
_PLAIN = re.compile(rf"{_CHARACTER}|{_WORD}")
_BETWEEN = re.compile(r"[\W_]+")
_DIGIT = re.compile(r"\d")
#: What every variable, default or tag has in it; texts without any have words and stops only.
_HINT = re.compile(r"[{}<>\[\]()$%@#«»*]|__|&lt;|XXXX|null|None|undefined|NaN")
_MIRROR = str.maketrans("{}<>[]()«»", "}{><][)(»«")

STOP, WORD, NUMBER, SPAN, DEFAULT, NAME, NAMES = range(7)
_KIND, _NO_KIND = np.uint64(7), ~np.uint64(7)
_GOLDEN, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Masks of a name and of a filling.
_A_NAME, _A_FILLING = np.uint64(8), np.uint64(16)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) & ~7


def variable(token: str) -> tuple[str, list[str], str, bool] | None:
    """(opening, words of the name, closing, whether quoted) of a token whose closing mirrors its opening."""
    m = _VARIABLE.fullmatch(token)
    if m is None:
        return None
    before, opening, inner, closing, after = m.groups()
    mirrored = opening.replace("&lt;", "&gt;") if "&" in opening else opening[::-1].translate(_MIRROR)
    return (opening, [w for w in _BETWEEN.split(inner.lower()) if w], closing, bool(before or after)) if closing in mirrored else None


class _Codes(dict):
    """Codes of tokens, 61 bits of hash and 3 of kind, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        if _PLAIN.fullmatch(token) and not _LEFT_OUT.fullmatch(token):
            if _DIGIT.search(token):
                code = _hash("#") | NUMBER
            else:
                code = _hash(token.lower()) | (NAME if len(token) > 1 and token.istitle() else WORD)
        elif _LEFT_OUT.fullmatch(token):
            code = _hash(token) | DEFAULT
        elif _VARIABLE.fullmatch(token):
            code = _hash(token) | SPAN
        else:
            code = STOP
        self[token] = code
        return code


def word_code(word: str) -> int:
    """The code of a word in lower case, as a signed number."""
    return int(np.uint64(_hash(word) | WORD).view(np.int64))


@dataclass
class Layout:
    """Tokens of several texts one after another, two stops around each.

    ``code``, ``chars``, ``text`` and ``unit`` are by token; units are what stands between stops.  The others are by
    ``at``, the tokens that begin a merged one: names that follow one another are one token there.
    """

    code: np.ndarray
    chars: np.ndarray
    text: np.ndarray
    unit: np.ndarray
    at: np.ndarray
    kind: np.ndarray
    context: np.ndarray
    filling: np.ndarray
    plain: np.ndarray

    def _around(self, *offsets: int, seed: int) -> np.ndarray:
        n, h = len(self.at), np.full(len(self.at), np.uint64(seed))
        for o in offsets:
            shifted = np.zeros(n, dtype=np.uint64)
            a, b = max(0, -o), min(n, n - o)
            shifted[a:b] = self.context[a + o : b + o]
            h = _mix(_mix(h) ^ shifted)
        return h.view(np.int64)

    def holes(self) -> tuple[np.ndarray, np.ndarray]:
        """(which merged tokens are words in a surrounding with a plain word, their holes)."""
        n = np.zeros(len(self.at), dtype=bool)
        for o in (-2, -1, 1):
            n |= np.roll(self.plain, -o)
        ok = n & ((self.kind == WORD) | (self.kind == NAME) | (self.kind == NAMES))
        return ok, self._around(-2, -1, 1, seed=1)

    def left(self) -> np.ndarray:
        return self._around(-2, -1, seed=2)

    def right(self) -> np.ndarray:
        return self._around(1, 2, seed=3)

    def words(self) -> np.ndarray:
        """Codes by token, titles as plain words."""
        return np.where((self.code & _KIND) == NAME, (self.code & _NO_KIND) | np.uint64(WORD), self.code)

    def triples(self) -> np.ndarray:
        w = self.words()
        return _mix(_mix(_mix(np.roll(w, 1) + _GOLDEN) ^ w) ^ np.roll(w, -1)).view(np.int64)


def _tokens(texts, codes: _Codes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, their codes, their lengths, tokens of each text), two stops around each text."""
    flat: list[str] = []
    counts = []
    for text in texts:
        found = (_TOKEN if _HINT.search(text) else _SIMPLE).findall(text)
        flat += ("\n", "\n")
        flat += found
        flat += ("\n", "\n")
        counts.append(len(found) + 4)
    code = np.array([codes[t] for t in flat], dtype=np.uint64)
    chars = np.where((code & _KIND) == STOP, 0, np.array([*map(len, flat)], dtype=np.int64))
    return flat, code, chars, np.array(counts, dtype=np.int64)


def layout(texts, codes: _Codes) -> Layout:
    return _arranged(*_tokens(texts, codes)[1:])


def _arranged(code: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> Layout:
    kinds = (code & _KIND).astype(np.int8)
    name = kinds == NAME
    starts = np.ones(len(code), dtype=bool)
    starts[1:] = ~(name[1:] & name[:-1])
    at = np.flatnonzero(starts)
    merged = code[at]
    if len(at):
        size = np.diff(np.append(at, len(code)))
        run = size > 1
        if run.any():
            merged = np.where(run, (np.add.reduceat(_mix(code), at) & _NO_KIND) | np.uint64(NAMES), merged)
    kind = (merged & _KIND).astype(np.int8)
    first = np.ones(len(at), dtype=bool)
    first[1:] = kind[:-1] == STOP
    lower = (merged & _NO_KIND) | np.uint64(WORD)
    context = merged.copy()
    context[kind == NAME] = np.where(first, lower, _A_NAME)[kind == NAME]
    context[kind == NAMES] = _A_NAME
    context[(kind == SPAN) | (kind == DEFAULT)] = _A_FILLING
    return Layout(
        code, chars, np.repeat(np.arange(len(counts)), counts), np.cumsum(kinds == STOP),
        at, kind, context, np.where(kind == NAME, lower, merged).view(np.int64), (kind == WORD) | ((kind == NAME) & first),
    )


def _strips(batch: pd.DataFrame):
    """A batch in pieces of at most ``STRIP_CHARS`` characters, or one text."""
    begin = size = 0
    for i, n in enumerate(batch["text"].str.len()):
        if size and size + n > STRIP_CHARS:
            yield batch.iloc[begin:i]
            begin, size = i, 0
        size += n
    if begin < len(batch):
        yield batch.iloc[begin:]


_SPAN_FIELDS = "kind: string, c1: long, c2: long, place: int, name: string, notation: string, whole: boolean, quoted: boolean, setting: long, l: long, r: long, code: long"
_STRIPS = f"c1 binary, c2 binary, counts binary, places binary, codes binary, chars binary, spans array<struct<{_SPAN_FIELDS}>>"


def _stripped(batches):
    """Texts as strips of tokens: a dictionary of (code, length) and the places of the texts in it.  With them what is bracketed, left out or seeded."""
    codes = _Codes()
    for batch in batches:
        for strip in _strips(batch):
            c1, c2 = strip["c1"].to_numpy(dtype=np.int64), strip["c2"].to_numpy(dtype=np.int64)
            tokens, code, chars, counts = _tokens(strip["text"], codes)
            spans = [*_seeded(c1, c2, strip["text"]), *_spans(c1, c2, tokens, _arranged(code, chars, counts))]
            both = _mix(code + _GOLDEN * chars.astype(np.uint64))
            _, first, place = np.unique(both, return_index=True, return_inverse=True)
            row = (c1.tobytes(), c2.tobytes(), counts.tobytes(), place.astype(np.uint32).tobytes(), code[first].tobytes(), chars[first].tobytes(), spans)
            yield pd.DataFrame([row], columns=["c1", "c2", "counts", "places", "codes", "chars", "spans"])


def _opened(batches):
    """(row of the batch, keys of the texts, layout) of strips."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            places = np.frombuffer(row.places, dtype=np.uint32)
            c1, c2, counts, chars = (np.frombuffer(b, dtype=np.int64) for b in (row.c1, row.c2, row.counts, row.chars))
            yield row, c1, c2, _arranged(np.frombuffer(row.codes, dtype=np.uint64)[places], chars[places], counts)


def _seeded(c1, c2, texts):
    """Words of sentences with two seed words."""
    for a, b, text in zip(c1.tolist(), c2.tolist(), texts):
        low = text.lower()
        if any(s in low for s in SEEDS):
            for sentence in re.split(r"[.!?…。]+(?=\s|$)|[\r\n]+", low):
                words = set(re.findall(r"[^\W\d_]+", sentence))
                if len(words.intersection(SEEDS)) >= 2:
                    yield from (("word", a, b, 0, w, "", True, False, 0, 0, 0, word_code(w)) for w in words)


def _spans(c1, c2, tokens: list[str], page: Layout):
    """Variables in all readings, and defaults."""
    places = np.flatnonzero((page.kind == SPAN) | (page.kind == DEFAULT))
    if not len(places):
        return
    left, right, owner = page.left(), page.right(), page.text[page.at]
    begins = np.searchsorted(owner, np.arange(len(c1)))
    within = np.arange(len(owner)) - begins[owner]
    setting = np.add.reduceat(_mix(page.context + _GOLDEN * within.astype(np.uint64)), begins).view(np.int64)
    for p in places.tolist():
        token, o = tokens[int(page.at[p])], int(owner[p])
        key, where = (int(c1[o]), int(c2[o]), int(within[p])), (int(setting[o]), int(left[p]), int(right[p]), 0)
        if page.kind[p] == DEFAULT:
            quoted = token[0] in "\"'`“”„" or token[-1] in "\"'`“”„"
            yield ("default", *key, "", token.strip("\"'`“”„")[:8], True, quoted, *where)
        elif (v := variable(token)) is not None:
            opening, words, closing, quoted = v
            for i in range(len(words)):
                for j in range(i + 1, min(i + 4, len(words) + 1)):
                    notation = " ".join([opening, *words[:i], "…", *words[j:], closing])
                    yield ("variable", *key, " ".join(words[i:j]), notation, j - i == len(words), quoted, *where)


def _variables(spans: DataFrame) -> DataFrame:
    """(c1, c2, place, notation, quoted, setting, l, r, token): the variables and defaults among all bracketed spans.

    A name counts as one of a variable with three notations, a notation with three such names; a name not known takes part
    if its notation holds known names in at least half of its texts.
    """
    read = spans.filter("kind = 'variable'")
    whole = read.filter("whole")
    known = whole.groupBy("name").agg(F.count_distinct("notation").alias("n")).filter("n >= 3").select("name", F.lit(True).alias("known"))
    told = read.join(known, "name", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    notations = told.groupBy("notation").agg(
        F.count_distinct(F.when(F.col("known"), F.col("name"))).alias("names"),
        F.sum(F.when(F.col("known"), 1).otherwise(0)).alias("held"),
        F.count(F.lit(1)).alias("all"),
    )
    kept = told.join(notations.filter("names >= 3"), "notation").filter("known OR (whole AND 2 * held >= all)")
    one = kept.groupBy("c1", "c2", "place").agg(F.min(F.struct("notation", "quoted", "setting", "l", "r")).alias("v"))
    variables = one.select("c1", "c2", "place", "v.*", F.lit(True).alias("variable"))
    defaults = spans.filter("kind = 'default'").select("c1", "c2", "place", "notation", "quoted", "setting", "l", "r", F.lit(False).alias("variable"))
    return variables.unionByName(defaults)


def _filter(codes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit per remainder of the codes: a bound of 2**bits, whatever their number."""
    at = F.pmod("code", F.lit(1 << bits)) + 1
    rows = codes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        begin = (r.bucket - 1) * 4096
        out[begin : begin + len(part)] |= part[: max(0, len(out) - begin)]
    return out


def _passes(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes & ((len(bits) << 3) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _among(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(len(codes), dtype=bool)
    return sorted_codes[np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)] == codes


def _sorted_codes(rows: DataFrame) -> np.ndarray:
    """At most ``MOST_BROADCAST`` codes, counted before."""
    chunks = rows.toArrow()["code"].chunks
    return np.sort(np.concatenate([np.empty(0, np.int64), *[c.to_numpy() for c in chunks]]))


def _surroundings(strips: DataFrame, wanted) -> DataFrame:
    """(code, open, usual, filled): holes that are open slots with the filling that has a fifth of all, 0 if none, and in how many texts wanted surroundings have ordinary words or wanted words occur."""

    def flushed(keys, fills):
        key, fill = np.concatenate(keys), np.concatenate(fills)
        both = _mix(key.view(np.uint64)) ^ fill.view(np.uint64)
        order = np.argsort(both, kind="stable")
        begins = np.flatnonzero(np.append(True, both[order][1:] != both[order][:-1])) if len(order) else order
        first = order[begins]
        return pd.DataFrame({"code": key[first], "fill": fill[first], "n": np.diff(np.append(begins, len(order)))})

    def count(batches):
        bits, held = wanted.value, 0
        keys: list[np.ndarray] = []
        fills: list[np.ndarray] = []
        for _, _, _, page in _opened(batches):
            ok, holes = page.holes()
            keys.append(holes[ok])
            fills.append(page.filling[ok])
            held += len(keys[-1])
            filled = np.flatnonzero((page.kind == WORD) | (page.kind == NUMBER) | (page.kind == NAME) | (page.kind == NAMES))
            owner = page.text[page.at]
            for surrounding in (page.left(), page.right(), page.words().view(np.int64)[page.at]):
                where = filled[_passes(bits, surrounding[filled])]
                if len(where):
                    once = np.unique(np.stack([owner[where], surrounding[where]]), axis=1)
                    keys.append(once[1])
                    fills.append(np.zeros(once.shape[1], dtype=np.int64))
                    held += once.shape[1]
            if held >= MOST_HELD:
                yield flushed(keys, fills)
                keys, fills, held = [], [], 0
        if keys:
            yield flushed(keys, fills)

    by_fill = strips.drop("spans").mapInPandas(count, "code long, fill long, n long").groupBy("code", "fill").agg(F.sum("n").alias("n"))
    word = F.col("fill") != 0
    by_hole = by_fill.groupBy("code").agg(
        F.count(F.when(word, 1)).alias("fills"), F.sum(F.when(word, F.col("n"))).alias("seen"),
        F.count(F.when(word & (F.col("n") == 1), 1)).alias("once"), F.sum(F.when(~word, F.col("n"))).alias("filled"),
        F.max(F.when(word, F.struct("n", "fill"))).alias("top"),
    )
    usual = F.when(F.col("top.n") >= 0.2 * F.col("seen"), F.col("top.fill")).otherwise(0)
    slot = (F.col("fills") > 12) | ((F.col("seen") >= 5) & (2 * F.col("once") >= F.col("seen")))
    return by_hole.select("code", slot.alias("open"), usual.alias("usual"), "filled").filter("open OR filled IS NOT NULL")


def _left_over(variables: DataFrame, filled: DataFrame) -> DataFrame:
    """(c1, c2) of texts that retain a variable or default in a slot."""
    sides = variables.select("*", F.explode(F.array("l", "r")).alias("code"))
    placed = sides.groupBy("code").agg(F.count_distinct("c1", "c2").alias("placed"), F.count_distinct("notation").alias("notations"), (F.min("setting") < F.max("setting")).alias("varied"))
    judged = placed.join(filled, "code", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    told = judged.select(
        "code",
        ((F.col("notations") >= 2) | (F.col("filled") >= F.greatest(F.col("placed"), F.lit(1)))).alias("weak"),
        ((F.col("notations") >= 2) | (F.col("filled") >= F.greatest(F.col("placed"), F.lit(3)))).alias("strong"),
        ((F.col("notations") == 1) & F.col("varied") & (F.col("filled") < F.col("placed"))).alias("literal"),
    )
    slot = F.when(F.col("variable"), F.col("weak")).otherwise(F.col("strong"))
    by_place = sides.filter("NOT quoted").join(told, "code").groupBy("c1", "c2", "place").agg(F.max(slot).alias("slot"), F.max("literal").alias("literal"))
    return by_place.filter("slot AND NOT literal").select("c1", "c2").distinct()


_PAGES = "c1 long, c2 long, total long, pseudo long, closed long, triples array<long>, chars array<int>"


def _open_holes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order and the usual fillings; at most ``MOST_BROADCAST``, counted before."""
    found = rows.toArrow()
    codes, usual = (np.concatenate([np.empty(0, np.int64), *[c.to_numpy() for c in found[name].chunks]]) for name in ("code", "usual"))
    order = np.argsort(codes)
    return codes[order], usual[order]


def _pages(strips: DataFrame, holes: DataFrame, latin) -> DataFrame:
    """Texts of which at least a third fills no open slot: their pseudo-text, and the triples of words of the other closed units."""
    spark = strips.sparkSession
    few = holes.count() <= MOST_BROADCAST
    known = spark.sparkContext.broadcast(_open_holes(holes) if few else None)

    def positions(batches):
        for row, _, _, page in _opened(batches):
            ok, around = page.holes()
            yield pd.DataFrame({"first": row.c1[:8] + row.c2[:8], "unit": page.unit[page.at][ok], "code": around[ok], "fill": page.filling[ok]})

    def closed(batches):
        for row, c1, c2, page in _opened(batches):
            n_units, n = int(page.unit[-1]) + 1, len(c1)
            is_open = np.zeros(n_units, dtype=bool)
            if known.value is not None:
                ok, around = page.holes()
                codes, usual = known.value
                if len(codes):
                    place = np.minimum(np.searchsorted(codes, around[ok]), len(codes) - 1)
                    is_open[page.unit[page.at][ok][(codes[place] == around[ok]) & (usual[place] != page.filling[ok])]] = True
            elif row.opened is not None:
                is_open[np.asarray(row.opened, dtype=np.int64)] = True
            word = (page.code & _KIND) != STOP
            size = np.bincount(page.unit, weights=word, minlength=n_units)
            pseudo = (size >= 2) & (np.bincount(page.unit, weights=_among(latin.value, page.words().view(np.int64)), minlength=n_units) >= 0.6 * size)
            shut = word & ~is_open[page.unit] & ~pseudo[page.unit]
            total, hidden, left = (np.bincount(page.text, weights=page.chars * w, minlength=n).astype(np.int64) for w in (word, word & pseudo[page.unit], shut))
            triples = np.where(shut, page.triples(), 0)  # a zero stands for all that lies between two runs of closed tokens
            sizes = np.where(shut, page.chars, 0).astype(np.int32)
            ends = np.searchsorted(page.text, np.arange(n + 1))
            kept = np.flatnonzero((total > 0) & (3 * (hidden + left) >= total))
            out = [(c1[i], c2[i], total[i], hidden[i], left[i], triples[ends[i] : ends[i + 1]], sizes[ends[i] : ends[i + 1]]) for i in kept.tolist()]
            yield pd.DataFrame(out, columns=["c1", "c2", "total", "pseudo", "closed", "triples", "chars"])

    bare = strips.drop("spans")
    if few:
        return bare.mapInPandas(closed, _PAGES)
    opened = bare.mapInPandas(positions, "first binary, unit long, code long, fill long").join(holes, "code").filter("fill != usual")
    by_strip = opened.groupBy("first").agg(F.collect_set("unit").alias("opened"))
    first = F.concat(F.substring("c1", 1, 8), F.substring("c2", 1, 8))
    return bare.withColumn("first", first).join(by_strip, "first", "left").mapInPandas(closed, _PAGES)


def _templates(pages: DataFrame, least: int) -> DataFrame:
    """(c1, c2, total, pseudo, closed, covered): ``covered`` characters are of words in a triple that at least ``least`` texts have in closed units."""
    own = pages.select("c1", "c2", F.explode(F.array_distinct("triples")).alias("code")).filter("code != 0")
    again = cut(own.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("code"))
    if again.count() <= MOST_BROADCAST:
        again = F.broadcast(again)
    repeated = own.join(again, "code", "left_semi").groupBy("c1", "c2").agg(F.collect_list("code").alias("again"))

    def cover(batches):
        for batch in batches:
            covered = []
            for triples, chars, known in zip(batch["triples"], batch["chars"], batch["again"]):
                hit = _among(np.sort(np.asarray(known, dtype=np.int64)), np.asarray(triples)) if known is not None and len(known) else np.zeros(len(triples), bool)
                near = hit.copy()
                near[1:] |= hit[:-1]
                near[:-1] |= hit[1:]
                covered.append(int(np.asarray(chars)[near].sum()))
            yield batch[["c1", "c2", "total", "pseudo", "closed"]].assign(covered=covered)

    return pages.join(repeated, ["c1", "c2"], "left").mapInPandas(cover, "c1 long, c2 long, total long, pseudo long, closed long, covered long")


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), text).alias("c1"), F.xxhash64(F.lit(2), text).alias("c2")]


def residue(df: DataFrame, key: str, text: str, least_texts: int = 3, least_filler: float = 0.45) -> DataFrame:
    """(key, reason): the documents with residue in place of content, one row per input row.

    ``reason`` is ``placeholder``, ``filler`` (pseudo-text, or template for at least ``least_filler`` of the characters of its
    words) or ``error page`` (at least nine tenths fill no open slot, and a third of it is template).  A triple of words is
    template if at least ``least_texts`` different texts have it outside open slots.  Null and empty texts, and texts
    without a word, are no case.  Null keys pass through and repeated rows come out repeatedly; an empty table gives an
    empty result; other columns are ignored, whatever their names.  Evidence needs a corpus: in a table of few texts little is
    residue.

    Texts are made distinct and read once; what is kept of them are strips of tokens, each with its own dictionary.  Counts are
    combined per strip before they are shuffled.  Surroundings of variables are counted
    behind a filter of fixed size and joined.  Open holes and repeated triples go to all tasks up to ``MOST_BROADCAST`` of
    them, beyond that they are joined, with the same result.  Words learned for pseudo-text are a vocabulary of 8 bytes a word.
    """
    spark = df.sparkSession
    t = F.col(f"`{text}`")
    docs = df.select(F.col(f"`{key}`").alias("k"), t.alias("text")).filter("text != ''")
    texts = docs.select(*_keys(F.col("text")), "text").dropDuplicates(["c1", "c2"])
    strips = cut(texts.mapInPandas(_stripped, _STRIPS))
    spans = cut(strips.select(F.explode("spans").alias("s")).select("s.*"))
    variables = cut(_variables(spans))
    seeded = spans.filter("kind = 'word'").groupBy("code").agg(F.count_distinct("c1", "c2").alias("seeded")).filter("seeded >= 2")
    asked = variables.select(F.explode(F.array("l", "r")).alias("code")).unionByName(seeded.select("code"))
    wanted = spark.sparkContext.broadcast(_filter(asked))
    around = cut(_surroundings(strips, wanted))
    filled = around.filter("filled IS NOT NULL").select("code", "filled")
    placeholders = _left_over(variables, filled)

    latin = spark.sparkContext.broadcast(_sorted_codes(seeded.join(filled, "code").filter("seeded >= 0.4 * filled").select("code")))
    pages = cut(_pages(strips, around.filter("open").select("code", "usual"), latin))
    judged = _templates(pages, least_texts)
    whole = (F.col("closed") + F.col("pseudo") >= 0.9 * F.col("total")) & (F.col("covered") >= 0.3 * F.col("total"))
    pseudo = F.col("pseudo") >= least_filler * F.col("total")
    filler = F.col("pseudo") + F.col("covered") >= least_filler * F.col("total")
    reason = F.when(pseudo, "filler").when(whole, "error page").when(filler, "filler")
    found = judged.select("c1", "c2", reason.alias("reason")).filter("reason IS NOT NULL")
    verdicts = cut(placeholders.withColumn("reason", F.lit("placeholder")).unionByName(found).groupBy("c1", "c2").agg(F.max("reason").alias("reason")))
    if verdicts.count() <= MOST_BROADCAST // 8:
        verdicts = F.broadcast(verdicts)
    keyed = docs.select("k", *_keys(F.col("text")))
    return keyed.join(verdicts, ["c1", "c2"]).select(F.col("k").alias(key), "reason")
