"""Text cut off by field limits or broken transfers.

Two kinds of evidence are combined for every text. Lengths: for each source a right-censored log-normal length distribution
is fitted by maximum likelihood, and lengths that hold many more texts than it explains are candidate limits, at which each
text has a posterior of being censored. Endings: word n-grams over all documents say how often a line or sentence ends, or a
word goes on, after the text's last words (its own ending left out); a logistic model is fitted to ends made by cutting
texts at random places against real ends, on a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import Scratch

SAMPLE_DOCS = 20_000  # documents of which cut and uncut ends train the ending model
FLUSH = 400_000  # tokens counted at once
FORMS = 500_000  # token forms kept by a worker
CJK = "぀-ヿ㐀-鿿ｦ-ﾟ"
TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
STOPS = ".!?。！？…"
CLOSERS = "\"'»”’“)]}」』›"
# A dot that text goes on after is one inside of a word or number.
INNER = re.compile(rf"\.(?=[^\s.{re.escape(CLOSERS)}])")
# Stops, newline, one ideograph, a word, digits, any other sign.
TOKEN = re.compile(rf"[{STOPS}]+|\n|[{CJK}]|[^\W\d_{CJK}]+|\d+|[^\w\s]|_")
MARK = re.compile(r"\s*(?:[\[(]\s*(?:\.{2,}|…)\s*[\])]|\.{3,}|…)$")
NOTHING, LINE, STOP, DOT, PREFIX, UNIT = range(6)
UNIT_TOKENS = 16
PREFIX_CHARS = 40  # longer words have no statistics of how they begin
TAIL = 160  # characters read at first for an end; more, if no line or sentence begins in them
ENDS = "doc_id long, source string, kind int, mark int, last int, broken int, chars int, bytes int, own int, k1 long, k2 long, k3 long, kp long, ku long"
REAL, CUT, UNSTOPPED = range(3)
PLAIN, STOPPED = 0, 1
MASK, ODD = (1 << 64) - 1, 0x9E3779B97F4A7C15
UNIT_SEED, PREFIX_SEED = 17, 18  # n-grams of n words have the seed n


def _fold(acc: int, h: int) -> int:
    acc = ((acc ^ h) * ODD) & MASK
    return acc ^ (acc >> 32)


def _folded(acc: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = (acc ^ h) * np.uint64(ODD)
    return acc ^ (acc >> np.uint64(32))


def _signed(acc: int) -> int:
    """A key as a long; its lowest three bits are left to the event."""
    acc &= ~7
    return acc - (1 << 64) if acc >> 63 else acc


def _key(seed: int, hashes) -> int:
    for h in hashes:
        seed = _fold(seed, h)
    return _signed(seed)


def _form(t: str) -> str:
    """The form of a token: words in lower case, digits as 0, stops as one."""
    c = t[0]
    return "0" if c.isdigit() else "." if c in STOPS else t.lower() if c.isalpha() else t


def _event(following: str) -> int:
    if following in ("\n", "#") or ord(following[0]) > 0x2190 and not following.isalpha():
        return LINE
    return STOP if following == "." else DOT if following == "·" else NOTHING


class _Vocabulary(dict):
    """Token to the number of its form, filled as tokens come; what a form is, is kept in lists."""

    def __init__(self) -> None:
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.number: dict[str, int] = {}
        self.hash: list[int] = []
        self.event: list[int] = []
        self.word: list[bool] = []
        self.starts: list[np.ndarray] = []
        self["\n"]  # form 0

    def __missing__(self, t: str) -> int:
        form = _form(t)
        i = self.number.get(form)
        if i is None:
            i = self.number[form] = len(self.hash)
            self.hash.append(xxhash.xxh3_64_intdigest(form))
            self.event.append(_event(form))
            self.word.append(form.isalnum())
            starts, acc = [], PREFIX_SEED
            if form[0].isalpha() and len(form) <= PREFIX_CHARS:
                for c in form[:-1]:
                    acc = _fold(acc, ord(c))
                    starts.append(acc)
            self.starts.append(np.array(starts, np.uint64))
        self[t] = i
        return i


_VOCABULARY = _Vocabulary()


def _tokens(text: str) -> list[int]:
    """Numbers of the forms of a text's tokens, with dots inside of words or numbers as ·; markup is a new line."""
    plain = TAG.sub("\n", text) if "<" in text else text
    v = _VOCABULARY
    return [v[t] for t in TOKEN.findall(INNER.sub("·", plain) if "." in plain else plain)]


def _forget() -> None:
    """Keep a worker's vocabulary bounded; numbers of forms hold until then."""
    if len(_VOCABULARY) > FORMS:
        _VOCABULARY.restart()


def _next_event(rest: str) -> int:
    """What a place before `rest` is followed by."""
    return _VOCABULARY.event[next(iter(_tokens(rest[:200])), 0)]


def _tallied(ids: list[int], sizes: list[int]) -> pa.RecordBatch:
    """Counts of what follows every one, two and three tokens of some texts, of words that go on after a prefix, and of whole lines and sentences."""
    v = _VOCABULARY
    t, n = np.array(ids, np.int64), len(ids)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h, kind, word = np.array(v.hash, np.uint64)[t], np.array(v.event, np.int64), np.array(v.word, bool)[t]
    line = np.uint64(v.hash[0])
    event = np.empty(n, np.int64)
    event[:-1] = kind[t[1:]]
    event[ends - 1] = LINE
    first = np.zeros(n, bool)
    first[starts] = True
    second = np.zeros(n, bool)
    second[starts[np.asarray(sizes) > 1] + 1] = True
    back = lambda by: np.concatenate([np.full(by, line), h[:-by]])[:n]
    before, before2 = np.where(first, line, back(1)), np.where(first | second, line, back(2))
    seed = lambda i: np.full(n, i, np.uint64)
    grams = [_folded(seed(1), h), _folded(_folded(seed(2), before), h), _folded(_folded(_folded(seed(3), before2), before), h)]
    low = ~np.uint64(7)
    found = [np.unique(np.concatenate([(g & low) | event.astype(np.uint64) for g in grams]), return_counts=True)]

    forms, times = np.unique(t, return_counts=True)
    begun = [v.starts[i] for i in forms]
    found.append(((np.concatenate(begun) & low) | np.uint64(PREFIX), np.repeat(times, [len(x) for x in begun])))

    # A unit ends with its line or sentence; signs before its first word don't count.
    last = np.flatnonzero((event == LINE) | (event == STOP))
    start = np.concatenate([[0], last[:-1] + 1])
    nearest = np.minimum.accumulate(np.where(word, np.arange(n), n)[::-1])[::-1]
    start = nearest[start]
    size = last + 1 - start
    good = (size > 0) & (size <= UNIT_TOKENS)
    start, size = start[good], size[good]
    acc = np.full(len(start), UNIT_SEED, np.uint64)
    for i in range(UNIT_TOKENS):
        on = np.flatnonzero(size > i)
        acc[on] = _folded(acc[on], h[start[on] + i])
    found.append(((acc & low) | np.uint64(UNIT), np.ones(len(acc), np.int64)))
    keyed, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array((keyed & low).view(np.int64)), pa.array((keyed & np.uint64(7)).astype(np.int32)), pa.array(counts.astype(np.int64))], names=["key", "event", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts over whole texts, some hundred thousand tokens at a time."""
    ids: list[int] = []
    sizes: list[int] = []
    for batch in batches:
        for text in batch.column(0).to_pylist():
            t = _tokens(text.rstrip())
            if not t:
                continue
            ids += t
            sizes.append(len(t))
            if len(ids) > FLUSH:
                yield _tallied(ids, sizes)
                ids, sizes = [], []
                _forget()
    if ids:
        yield _tallied(ids, sizes)


def _last_unit(text: str) -> tuple[list[int], int]:
    """Tokens at the end of a text, and where among them its last line or sentence begins; as much is read as that takes."""
    v, size = _VOCABULARY, TAIL
    while True:
        t = _tokens(text[-size:])
        start = next((i + 1 for i in range(len(t) - 2, -1, -1) if v.event[t[i + 1]] in (LINE, STOP) or v.event[t[i]] == STOP or t[i] == 0 or v.hash[t[i]] == _HASH), 0)
        # The first token may be cut by the window.
        if size >= len(text) or (start and len(t) > 4):
            return t, start
        size *= 4


_HASH = xxhash.xxh3_64_intdigest("#")


def _ending(text: str, own: int) -> tuple[int, int, int, int, int, int]:
    """(own event, k1, k2, k3, kp, ku) of the place after text."""
    v = _VOCABULARY
    t, start = _last_unit(text)
    h = [v.hash[0]] * 2 + [v.hash[i] for i in t]
    a, b, c = h[-3:]
    unit = t[start:]
    at = next((i for i, x in enumerate(unit) if v.word[x]), len(unit))
    ku = _key(UNIT_SEED, [v.hash[x] for x in unit[at:]]) if 0 < len(unit) - at <= UNIT_TOKENS else 0
    word = re.search(rf"[^\W\d_{CJK}]+$", text[-PREFIX_CHARS - 1 :])
    kp = _key(PREFIX_SEED, map(ord, word.group().lower())) if word and len(word.group()) <= PREFIX_CHARS else 0
    return own, _key(1, (c,)), _key(2, (b, c)), _key(3, (a, b, c)), kp, ku


def _core(text: str) -> tuple[str, int, int]:
    """The text up to its last word, whether a mark of omission follows (2 if in brackets), whether it ends with a stop."""
    body = text
    while (m := re.search(r"(?:</?[A-Za-z][^<>]{0,80}>|\s)+$", body[-200:])) and m.group():
        body = body[: len(body) - len(m.group())]
    # All of the dots, brackets and blanks at the end.
    signs = len(body) - len(body.rstrip(" \t\r\n\xa0.…[]()"))
    if m := MARK.search(body[len(body) - signs :]):
        core = body[: len(body) - len(m.group())].rstrip()
        return core, 2 if m.group().strip()[0] in "[(" else 1, PLAIN
    bare = body.rstrip(CLOSERS)
    if bare and bare[-1] in STOPS:
        return bare.rstrip(STOPS), 0, STOPPED
    return body, 0, PLAIN


def _endings(rate: float):
    """The end of every text, and made ends of the sampled ones."""
    schema = pa.schema([(c.split(" ")[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split(" ")[1]]) for c in ENDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, source in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "source")), strict=True):
                whole = text.rstrip()
                core, mark, last = _core(whole)
                size = (len(whole), len(whole.encode()))
                own = STOP if last == STOPPED or mark == 1 else NOTHING if mark == 2 else LINE
                out.append((doc, source, REAL, mark, last, int(core.endswith("\ufffd")), *size, *_ending(core, own)))
                draw = xxhash.xxh3_64_intdigest(str(doc))
                if (draw >> 11) * 2.0**-53 >= rate:
                    continue
                dice = np.random.default_rng(draw)
                if last == STOPPED:
                    out.append((doc, source, UNSTOPPED, 0, PLAIN, 0, *size, *_ending(core, STOP)))
                for _ in range(2):
                    at = int(dice.integers(1, max(2, len(whole))))
                    cut, rest = whole[:at].rstrip(), whole[at:]
                    # Only cuts inside of a sentence: the cut must not follow a stop or end a line.
                    if not cut or not rest or cut[-1] in STOPS + CLOSERS or rest.lstrip(" ")[:1] in ("", "\n", "\r", *STOPS, "<", "#"):
                        continue
                    inside = whole[at - 1].isalnum() and rest[0].isalnum()
                    out.append((doc, source, CUT, 0, PLAIN, 0, *size, *_ending(cut, -1 if inside else _next_event(rest))))
            _forget()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _normal_tail(z: float) -> float:
    return max(0.5 * (1 - erf(z / sqrt(2))), 1e-12)


def fit_censored(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Maximum likelihood of a log-normal with a share of the counts right-censored at their length: mean and spread of the log.

    Expectation maximisation: a censored length is replaced by the first two moments beyond it.
    """
    x = np.log(lengths)
    mu = float(np.average(x, weights=counts))
    sd = max(0.05, float(np.sqrt(np.average((x - mu) ** 2, weights=counts))))
    for _ in range(rounds):
        z = (x - mu) / sd
        hazard = np.array([exp(-min(v * v / 2, 600)) / sqrt(2 * pi) / _normal_tail(v) for v in z])
        first = np.where(censored > 0, mu + sd * hazard, x)
        second = np.where(censored > 0, mu * mu + sd * sd + sd * (x + mu) * hazard, x * x)
        m1 = np.sum(counts * ((1 - censored) * x + censored * first)) / counts.sum()
        m2 = np.sum(counts * ((1 - censored) * x * x + censored * second)) / counts.sum()
        mu, sd = float(m1), max(0.05, float(np.sqrt(max(m2 - m1 * m1, 0.0025))))
    return mu, sd


BIN = 50  # lengths of one bin differ by about two percent
AROUND = 10  # lengths on either side that are a length's surroundings
LEAST = 4  # texts that make a length a candidate


def _limits(part: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source and unit: peaks with many more texts than the fit explains.

    part: the peaks at their lengths, and all other lengths in bins.
    """
    x, n = part.length.to_numpy(float), part.n.to_numpy(float)
    peak, around = part.peak.to_numpy(bool), part.around.to_numpy(float)
    share, found = np.zeros(len(x)), np.zeros(len(x), bool)
    for _ in range(4 if peak.any() else 0):
        mu, sd = fit_censored(x, n, share)
        density = np.exp(-(((np.log(x) - mu) / sd) ** 2) / 2) / (x * sd * sqrt(2 * pi)) * n.sum()
        expected = np.maximum(density, around)
        # A chance count this high, among as many lengths as there are texts, has a probability of at most e^-3.
        chance = n * np.log(n / np.maximum(expected, 1e-9)) - n + expected
        found = peak & (n > expected) & (chance > log(n.sum()) + 3)
        share = np.where(found, np.clip(1 - expected / np.maximum(n, 1), 0, 0.999), 0)
    out = part.loc[found, ["source", "unit"]].copy()
    out["length"], out["censored"] = x[found].astype(np.int64), share[found]
    return out


def length_limits(lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, unit, length, censored): lengths that a source's texts have too often, with the share that was cut there.

    lengths: source, unit and length (at least 1), a row for each text. Lengths are exact at any size. Those with more texts than their
    surroundings explain are peaks; the others are binned for the fit only, so a source has about a thousand rows besides its peaks.
    """
    by = ["source", "unit", "length"]
    counts = scratch.save(lengths.groupBy(*by).agg(F.count("*").alias("n")), "lengths")
    busy = counts.where(F.col("n") >= LEAST)
    near = busy.select(*by, F.explode(F.array(*[F.lit(i) for i in range(-AROUND, AROUND + 1) if i])).alias("off")).withColumn("at", F.col("length") + F.col("off"))
    others = near.join(counts.select("source", "unit", F.col("length").alias("at"), F.col("n").alias("m")), ["source", "unit", "at"]).groupBy(*by).agg((F.sum("m") / (2 * AROUND)).alias("around"))
    peaks = busy.join(others, by, "left").withColumn("around", F.coalesce("around", F.lit(0.0))).where(F.col("n") > F.col("around") + 4 * F.sqrt(F.col("around") + 0.25))
    peaks = scratch.save(peaks, "peaks")
    rest = counts.join(peaks.select(*by), by, "left_anti").groupBy("source", "unit", F.floor(F.log("length") * BIN).alias("bin"))
    rest = rest.agg((F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("length"), F.sum("n").alias("n"))
    rows = rest.select("source", "unit", "length", "n", F.lit(0.0).alias("around"), F.lit(False).alias("peak")).unionByName(peaks.select("source", "unit", F.col("length").cast("double").alias("length"), "n", "around", F.lit(True).alias("peak")))
    return scratch.save(rows.groupBy("source", "unit").applyInPandas(_limits, "source string, unit string, length long, censored double"), "limits")


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic model by Newton's method; each class counts as a half."""
    a = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


FEATURES = ["f_line", "f_stop", "f_word", "f_seen", "f_both", "f_never", "f_unit"]


def _featured(ends: DataFrame, counts: DataFrame) -> DataFrame:
    """The n-gram evidence of each end, its own occurrence left out."""
    slots = ends.select("eid", F.inline(F.array(*[F.struct(F.lit(i).alias("slot"), F.col(c).alias("key")) for i, c in enumerate(("k1", "k2", "k3", "kp", "ku"), 1)]))).where("key <> 0")
    known = slots.join(counts, "key").groupBy("eid").agg(*[F.max(F.when(F.col("slot") == i, F.struct("n0", "n1", "n2", "n3", "n4", "n5"))).alias(f"c{i}") for i in (1, 2, 3, 4, 5)])
    d = ends.join(known, "eid", "left")
    own = F.when(F.col("own") >= 0, 1).otherwise(0)
    zero = F.lit(0)

    def seen(i: int, event: int | None) -> F.Column:
        c = F.col(f"c{i}")
        if event is not None:
            return F.greatest(F.coalesce(c[f"n{event}"], zero) - F.when(F.col("own") == event, 1).otherwise(0), zero)
        return F.greatest(sum(F.coalesce(c[f"n{e}"], zero) for e in range(4)) - own, zero)

    def share(event: int) -> F.Column:
        p = F.lit(0.05)
        for i, a in ((1, 4.0), (2, 2.0), (3, 1.0)):
            p = (seen(i, event) + a * p) / (seen(i, None) + a)
        return p

    logit = lambda p: F.log(p / (1 - p))
    both = F.least(F.col("p_line") + F.col("p_stop"), F.lit(1 - 1e-4))
    squeeze = lambda p: F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    d = d.withColumns({"p_line": squeeze(share(LINE)), "p_stop": squeeze(share(STOP)), "p_dot": squeeze(share(DOT)), "n_word": seen(1, None), "n_seen": seen(3, None), "n_longer": F.coalesce(F.col("c4")["n4"], zero)})
    return d.withColumns({
        "f_line": logit(F.col("p_line")),
        "f_stop": logit(F.col("p_stop")),
        # Whether the last word is a whole one matters less where lines and sentences end with it.
        "f_word": F.when(F.col("kp") == 0, 0.0).otherwise(F.greatest(F.least(F.log((F.col("n_word") + 0.1) / (F.col("n_longer") + 0.5)), F.lit(3.0)), F.lit(-5.0))) * F.pow(1 - both, 4.0),
        "f_seen": F.log(F.col("n_seen") + 0.2),
        "f_both": F.log(both),
        # Last words seen often, after which the text always went on.
        "f_never": F.when(both < 0.02, F.log(F.col("n_seen") + 1.0)).otherwise(0.0),
        # Other lines and sentences that are the same as the last one.
        "f_unit": F.log(F.greatest(F.coalesce(F.col("c5")["n5"], zero) - F.when(F.col("own").isin(LINE, STOP), 1).otherwise(0), zero) + 0.3),
    }).select("doc_id", "source", "kind", "mark", "last", "broken", "chars", "bytes", "p_stop", "p_dot", *FEATURES)


def truncated(documents: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", source: str = "source", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(key, source, cut, posterior): for every document whether its text stops before its end.

    Null keys are dropped. Null, empty and blank texts are not cut. Documents without a source form a source of their own. Texts are read whole and
    of any length; a repeated key gives a row each time; an empty table gives an empty table; other columns are dropped.
    Counts cover all documents; sample_docs bounds the documents that train the ending model only.
    """
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source")).where("doc_id is not null")
    written = F.coalesce(F.col("text").rlike(r"[^\s\p{Z}]"), F.lit(False))
    used = docs.where(written)
    total = used.count()
    rate = min(1.0, sample_docs / max(1, total))
    per = lambda e: F.sum(F.when(F.col("event") == e, F.col("n")).otherwise(0)).alias(f"n{e}")
    counts = used.select("text").mapInArrow(_count, "key long, event int, n long").groupBy("key").agg(*[per(e) for e in range(6)])
    ends = scratch.save(used.mapInArrow(_endings(rate), ENDS).withColumn("eid", F.monotonically_increasing_id()), "ends")
    seen = scratch.save(_featured(ends, counts), "evidence")
    real = seen.where(F.col("kind") == REAL)

    # Lengths in characters and in bytes.
    units = F.inline(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("long").alias("length")) for u in ("chars", "bytes")]))
    limits = length_limits(real.select(F.coalesce("source", F.lit("")).alias("source"), units), scratch)
    # A cut in bytes spares the character it would split, so it may be up to three bytes short.
    reach = limits.select(F.col("source").alias("s"), "unit", F.col("length").alias("limit"), "censored", F.explode(F.when(F.col("unit") == "bytes", F.array(*[F.lit(i) for i in range(4)])).otherwise(F.array(F.lit(0)))).alias("short"))
    reach = reach.select("s", "unit", F.col("limit"), (F.col("limit") - F.col("short")).alias("length"), "short", "censored")
    # A text without a source may come under any source's limit.
    reach = reach.unionByName(reach.where("s <> ''").groupBy(F.lit("").alias("s"), "unit", "limit", "length", "short").agg((F.max("censored") / 2).alias("censored")))
    at = real.select("*", units).withColumn("s", F.coalesce("source", F.lit("")))
    at = at.join(reach, ["s", "unit", "length"]).where((F.col("short") == 0) | (F.col("bytes") > F.col("chars")))

    model = _ending_models(seen, limits, sample_docs)
    score = lambda d: d.withColumn("end_logit", _end_logit(model))
    # What share of the texts at a candidate limit has a cut ending decides whether it is one.
    confirmed = score(at).withColumn("p", 1 / (1 + F.exp(-F.col("end_logit")))).groupBy("s", "unit", "limit").agg(F.avg("p").alias("open_share"))
    prior = at.join(confirmed, ["s", "unit", "limit"]).groupBy("doc_id").agg(F.max(F.struct((F.least("open_share", F.lit(0.98)) * F.col("censored")).alias("p"), "limit")).alias("best"))
    shape = (F.col("last") * 3 + F.col("mark")).alias("shape")
    scored = scratch.save(score(real).join(prior, "doc_id", "left").select("doc_id", "source", shape, "end_logit", F.col("best.p").alias("limit_p"), F.col("best.limit").alias("limit")), "scored")
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in {-1: 0.02, **_base_rates(scored)}.items() for x in kv])[F.col("shape")], F.lit(0.02))
    odds = F.least(F.greatest(F.coalesce(F.greatest("limit_p", base), base), F.lit(1e-3)), F.lit(0.98))
    posterior = 1 / (1 + F.exp(-(F.col("end_logit") + F.log(odds / (1 - odds)))))
    result = scored.select("doc_id", "source", posterior.alias("posterior"))
    blank = docs.where(~written).select("doc_id", "source", F.lit(0.0).alias("posterior"))
    return result.unionByName(blank).select(F.col("doc_id").alias(key), F.col("source").alias(source), (F.col("posterior") >= 0.5).alias("cut"), "posterior")


def _ending_models(seen: DataFrame, limits: DataFrame, sample_docs: int) -> dict[str, list[float]]:
    """Logistic weights for ends without ('plain') and with ('marked') a mark of omission, from the bounded sample."""
    near = limits.select(F.col("source").alias("s"), F.col("length").alias("chars"), F.lit(True).alias("limited")).distinct()
    rows = seen.where((F.col("kind") != REAL) | ((F.col("mark") == 0) & (F.col("last") == PLAIN)))
    made = rows.where(F.col("kind") != REAL).limit(3 * sample_docs)
    real = rows.where(F.col("kind") == REAL).withColumn("s", F.coalesce("source", F.lit(""))).join(near, ["s", "chars"], "left_anti")
    real = real.orderBy(F.xxhash64("doc_id")).limit(sample_docs).select(*made.columns)
    sample = made.unionByName(real).select("kind", *FEATURES).toPandas()
    x, kind = sample[FEATURES].to_numpy(float), sample.kind.to_numpy()
    out = {}
    for name, negatives in (("plain", (REAL,)), ("marked", (REAL, UNSTOPPED))):
        use = (kind == CUT) | np.isin(kind, negatives)
        xs, ys = x[use], (kind[use] == CUT).astype(float)
        if ys.sum() < 5 or (1 - ys).sum() < 5:
            out[name] = [0.0, -0.5, -0.1, -0.5, 0.0, -0.5, 0.3, -0.5]
            continue
        keep = np.ones(len(ys), bool)
        # Some real ends are cut: those that look so are left out, and the model is fitted anew.
        for _ in range(4):
            w = _logistic(xs[keep], ys[keep])
            p = 1 / (1 + np.exp(-np.clip(w[0] + xs @ w[1:], -30, 30)))
            keep = (ys == 1) | (p < 0.7)
        out[name] = w.tolist()
    return out


def _end_logit(model: dict[str, list[float]]) -> F.Column:
    """Log-odds that an end is cut; after a stop it is only if the stop is one inside a number or name."""
    line = lambda w: F.lit(w[0]) + sum(F.lit(v) * F.col(f) for v, f in zip(w[1:], FEATURES, strict=True))
    stopped = F.log(F.col("p_dot") / (F.col("p_stop") + F.col("p_dot") + 0.02)) - 1.0
    # Half a character, or an omission in brackets, is an end of its own.
    sure = (F.col("broken") == 1) | (F.col("mark") == 2)
    return F.when(sure, 12.0).when(F.col("last") == STOPPED, stopped).when(F.col("mark") == 0, line(model["plain"])).otherwise(line(model["marked"]))


def _base_rates(scored: DataFrame, rounds: int = 20) -> dict[int, float]:
    """Per kind of ending the share of texts cut elsewhere than at a limit, by expectation maximisation over binned log-odds."""
    binned = F.round(F.greatest(F.least("end_logit", F.lit(20.0)), F.lit(-20.0)) * 4).cast("int")
    bins = scored.where("limit_p is null").groupBy("shape", binned.alias("b")).count().collect()  # at most 161 bins of each kind
    out = {}
    for shape in {r["shape"] for r in bins}:
        logit, n = (np.array([v for r in bins if r["shape"] == shape for v in [f(r)]], float) for f in (lambda r: r["b"] / 4, lambda r: r["count"]))
        rate = 0.02
        for _ in range(rounds):
            rate = float(np.clip(np.average(1 / (1 + np.exp(-(logit + log(rate / (1 - rate))))), weights=n), 1e-3, 0.5))
        out[shape] = rate
    return out


def rates(found: DataFrame, source: str = "source") -> DataFrame:
    """Per source the number of documents, of cut ones, and their share; documents without a source are one row with null."""
    return found.groupBy(source).agg(F.count("*").alias("n_docs"), F.count_if("cut").alias("n_cut")).withColumn("rate", F.col("n_cut") / F.col("n_docs"))
