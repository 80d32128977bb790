"""One spelling for text that displays alike in different characters.

Compatibility forms (full width and the like), kinds of blanks and hyphens, and composed or decomposed accents are
brought to one form, ignorable characters go; superscripts, letter case and accents stay. Then the letters of each
token form a lattice of their look-alikes in the Latin, Cyrillic, Greek, Armenian and Cherokee scripts, and a Viterbi search finds its most
probable reading under character bigram scores of each script. The lattice depends on what is displayed only, so texts
that display alike get one reading.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import Scratch

# Letters that display alike, within Latin (phonetic letters, small capitals) and across scripts. Digits and accents are no letters here.
LOOKALIKES = """
A А Α Ꭺ|B В Β|C С Ϲ Ꮯ|D Ꭰ|E Е Ε Ꭼ|G Ԍ Ꮐ|H Н Η Ꮋ|I І Ι Ӏ|J Ј Ϳ Ꭻ|K К Κ Ꮶ|L Լ Ꮮ|M М Μ Ꮇ|N Ν|O О Ο Օ|P Р Ρ Ꮲ|Q Ԛ|R Ꭱ|S Ѕ Տ Ꮪ|T Т Τ Ꭲ|U Ս|V Ꮩ|W Ԝ Ꮃ|X Х Χ|Y Ү Υ|Z Ζ Ꮓ
a а ɑ|c с ϲ ᴄ|d ԁ|e е|g ɡ ց|h һ հ|i і|j ј ϳ յ|l ӏ|n ո|o о ο օ ᴏ|p р ρ|q ԛ զ|s ѕ ꜱ|u ս|v ѵ ν ᴠ|w ԝ ᴡ|x х|y у|z ᴢ|Г Γ|П Π|Ф Φ|к κ
"""
HYPHENS = "‐‑‒–−﹣－⁃"
# Compatibility decompositions that keep what is displayed; super, sub, circle, square, fraction and font do not.
KEEPING = ("<wide>", "<narrow>", "<noBreak>", "<small>", "<vertical>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
IGNORABLE = "͏ᅟᅠ឴឵ㅤﾠ⠀"
MARK = "̀-ͯ"
TOKEN = re.compile(rf"[^\W\d_][^\W\d_{MARK}]*(?:[{MARK}]+[^\W\d_]*)*")
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
MIX_COST = 12.0  # log score of a change of script within a token


class _Plain(dict):
    """Code point to what it is displayed as, filled as characters come."""

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        kind, made = unicodedata.category(ch), unicodedata.decomposition(ch)
        if ch in HYPHENS:
            out = "-"
        elif kind in ("Zs", "Zl", "Zp") or ch in "\t\n\r":
            out = " "
        elif kind in ("Cf", "Cc") or ch in IGNORABLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F:
            out = ""
        elif made.startswith(KEEPING):
            full = unicodedata.normalize("NFKC", ch)
            out = full if " " not in full else ch
        else:
            out = ch
        self[cp] = out
        return out


_PLAIN = _Plain()


def plain(text: str) -> str:
    """Compatibility normalization without change of what is displayed, decomposed."""
    return text if text.isascii() and text.isprintable() else unicodedata.normalize("NFD", text.translate(_PLAIN))


def script(ch: str) -> int | None:
    """The number of a letter's script in SCRIPTS; None for marks and other scripts."""
    name = unicodedata.name(ch, "").split(" ")[0]
    return SCRIPTS.index(name) if name in SCRIPTS else None


def _classes() -> dict[str, tuple[tuple[str, int], ...]]:
    """Letter to its look-alikes as (letter, script)."""
    out = {}
    for group in re.split(r"[|\n]", LOOKALIKES.strip()):
        members = tuple((c, script(c)) for c in group.split())
        out.update({c: members for c, _ in members})
    return out


CLASSES = _classes()


def bigrams(texts: Iterable[str | None]) -> Counter:
    """Counts of neighbouring letters, ^ and $ for a token's ends, of tokens written in one script."""
    counts: Counter = Counter()
    tokens: Counter = Counter()
    for text in texts:
        if text:
            tokens.update(TOKEN.findall(plain(text)))
    for token, n in tokens.items():
        letters = [c for c in token if not unicodedata.combining(c)]
        if len({script(c) for c in letters}) == 1 and script(letters[0]) is not None:
            for a, b in zip(["^", *letters], [*letters, "$"], strict=True):
                counts[a, b] += n
    return counts


class Reader:
    """The most probable reading of displayed text under script-wise bigram counts."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.counts = counts
        self.total: Counter = Counter()
        self.seen: Counter = Counter()
        for (a, b), n in counts.items():
            self.total[a] += n
            self.seen[a] += 1
        starts: Counter = Counter()
        for (a, b), n in counts.items():
            if a == "^":
                starts[script(b)] += n
        self.prior = [math.log((starts[s] + 1) / (sum(starts.values()) + len(SCRIPTS))) for s in range(len(SCRIPTS))]
        self.cache: dict[str, str] = {}

    def _log(self, a: str, b: str) -> float:
        # Absolute discounting towards a uniform alphabet of 64 letters.
        n, all_, kinds = self.counts.get((a, b), 0), self.total[a], self.seen[a]
        return math.log((max(n - 0.5, 0) + (0.5 * kinds + 0.5) / 64) / (all_ + 0.5))

    def token(self, token: str) -> str:
        """Viterbi over the token's look-alike lattice; equal scores go to the first script."""
        if (known := self.cache.get(token)) is not None:
            return known
        # A state is (last letter, its script); marks and letters of other scripts pass through.
        best: dict[tuple[str, int | None], tuple[float, str]] = {("^", None): (0.0, "")}
        for ch in token:
            if unicodedata.combining(ch):
                best = {k: (v, path + ch) for k, (v, path) in best.items()}
                continue
            options = CLASSES.get(ch) or ((ch, script(ch)),)
            step: dict[tuple[str, int | None], tuple[float, str]] = {}
            for letter, s in options:
                top = None
                for (last, t), (v, path) in best.items():
                    if last == "^":
                        v += self.prior[s] if s is not None else 0.0
                    score = v + self._log(last, letter) - (MIX_COST if last != "^" and s != t else 0.0)
                    if top is None or score > top[0] + 1e-12:
                        top = (score, path + letter)
                step[letter, s] = top
            best = step
        done = max(((v + self._log(last, "$"), -(s if s is not None else 9), path) for (last, s), (v, path) in best.items()), key=lambda x: (round(x[0], 9), x[1]))
        if len(self.cache) > 500_000:
            self.cache.clear()
        self.cache[token] = done[2]
        return done[2]

    def text(self, text: str | None) -> str | None:
        """The one spelling of a text: null stays null, empty stays empty."""
        if text is None:
            return None
        return unicodedata.normalize("NFC", TOKEN.sub(lambda m: self.token(m.group()), plain(text)))


def letter_counts(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], int]:
    """Bigram counts over all rows of the columns.

    They come to the driver: at most the square of the letters of some scripts, whatever the number of rows.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for c in batch.columns:
                counts.update(bigrams(batch[c]))
        if counts:
            yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["a", "b", "n"])

    rows = df.select(*columns).mapInPandas(part, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return {(r.a, r.b): r.n for r in rows}


def with_spelling(df: DataFrame, columns: dict[str, str], counts: dict[tuple[str, str], int]) -> DataFrame:
    """Add for each column its one spelling under the given name. Rows and order of columns are kept."""

    @F.pandas_udf("string")
    def spell(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(counts)
        whole: dict = {}
        for part in parts:
            if len(whole) > 200_000:
                whole.clear()
            out = []
            for text in part:
                if (known := whole.get(text)) is None and text is not None:
                    known = whole[text] = reader.text(text)
                out.append(known)
            yield pd.Series(out, dtype=object)

    return df.withColumns({new: spell(F.col(old)) for old, new in columns.items()})


def same_looking(left: DataFrame, right: DataFrame, scratch: Scratch, within: str, left_id: str, right_id: str, left_parts: tuple[str, str], right_parts: tuple[str, str]) -> DataFrame:
    """(left_id, right_id): rows of one `within` whose two parts display alike, but are not the same characters in both.

    Nulls in an id, `within` or a part match nothing. Only spellings that occur in more than one form are joined, first as
    distinct spellings, then with their ids; rows of one spelling, however many, are never paired.
    """
    one = lambda df, key, parts, side: df.select(F.lit(side).alias("side"), F.col(key).alias("id"), F.col(within).alias("place"), F.col(parts[0]).alias("p"), F.col(parts[1]).alias("q")).dropna()
    rows = one(left, left_id, left_parts, 0).unionByName(one(right, right_id, right_parts, 1))
    rows = scratch.save(rows, "names")
    rows = scratch.save(with_spelling(rows, {"p": "np", "q": "nq"}, letter_counts(rows, ["p", "q"])), "spelt")
    key = ["place", "np", "nq"]
    form = F.struct("p", "q")
    varied = rows.groupBy(*key).agg(F.min(form).alias("lo"), F.max(form).alias("hi"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    varied = varied.where("lo <> hi and s0 < s1").select(*key)
    rows = scratch.save(rows.join(varied, key, "left_semi"), "varied")
    forms = rows.select("side", *key, "p", "q").distinct()
    a = forms.where("side = 0").select(*key, "p", "q")
    b = forms.where("side = 1").select(*key, F.col("p").alias("p2"), F.col("q").alias("q2"))
    pairs = a.join(b, key).where("not (p = p2 and q = q2)").select("place", "p", "q", "p2", "q2")
    ids = lambda side, name, p, q: rows.where(F.col("side") == side).select("place", F.col("p").alias(p), F.col("q").alias(q), F.col("id").alias(name))
    found = pairs.join(ids(0, left_id, "p", "q"), ["place", "p", "q"]).join(ids(1, right_id, "p2", "q2"), ["place", "p2", "q2"])
    return found.select(left_id, right_id)
