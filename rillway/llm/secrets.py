"""Secret scans: base patterns, and credential values that are dear to guess.

A value's guess cost is the least total of log10 guesses over all ways to cut it into known words,
dates, repeats, walks along keyboard rows or the alphabet, and brute-force spans. Values that stand in a
credential context which the base patterns miss, and cost at least ``THRESHOLD``, add spans. Known words
come ranked from a public vocabulary file, read at run time.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.store import bounded

#: The base patterns.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "guess")

#: One value: no blank and no quote; the next of several named values, as in a query string, ends it.
_VALUE = r"""(?:(?![&;,][A-Za-z_][A-Za-z0-9_.-]*[=:])[^\s'])"""
#: Contexts of the method: a credential's name, then a separator, then one value.
CONTEXT = re.compile(
    r"""(?i)(?a:\b)(?:pwd|pass|passphrase|passcode|passkey|passwort|credentials?|auth(?:orization)?|bearer|private[_-]?key|access[_-]?key|client[_-]?secret|signing[_-]?key|session[_-]?key|db[_-]?pass|login|password|passwd|secret|token|api[_-]?key)["']?(?:(?P<sep>\x20*(?:[:=]+|=>|->)\x20*)|\x20+is\x20+|\x20+)["']?(?P<value>"""
    + _VALUE + "{6,})"
)
USERINFO = re.compile(r"(?a)://[^\s:@/]+:(?P<value>[^\s:@/]{6,})@")
#: A phrase of words is a secret as a whole: four or more, alone to the end of their line or quote.
PHRASE = re.compile(r"""(?i)\b(?:pass|seed|recovery)[\x20_-]?phrase["']?\x20*[:=]\x20*(?P<quote>["']?)(?P<value>[^\W\d_]+(?:[\x20-][^\W\d_]+){3,23})(?=(?P=quote)[\x20\t]*(?:$|[\r\n]))""")
_WHOLE = re.compile(_VALUE + "+")
_END = "\"'.,;:)]}>"
THRESHOLD = 9.0
CACHED = 256
_LONGEST_NAME = 64

#: Words of high rank in published lists of common passwords, and stand-ins for a value.
WORDS = """password passwd secret token admin administrator root user guest login welcome letmein monkey dragon
master shadow sunshine princess football baseball superman batman trustno iloveyou abc qwerty love hello
changeme change me example sample test testing demo default placeholder dummy your my the here key api value
none null true false undefined redacted hidden required optional string summer winter spring autumn
january february march april may june july august september october november december""".split()
#: The longest words of a dictionary that count, and how many of its words, in its order.
LONGEST_WORD, DICTIONARY_WORDS = 20, 30_000
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
_NEXT = {(a, b) for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
_LEET = str.maketrans("4@310$5!7", "aaelossit")
_DATE = re.compile(r"(?a)(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)")
_PER_SEGMENT = 0.3
_CUT = LONGEST_WORD + 3


def dictionary_path() -> str:
    """The public vocabulary that the queries use; another file of ranked words with ends may be given."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def ranked(path: str | None) -> dict[str, int]:
    """Rank of each known word: WORDS first, then the whole words of the vocabulary in its order, which is
    about that of their frequency. Without a path WORDS alone."""
    found = list(WORDS)
    if path:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        whole = (t.removesuffix(end) for t in sorted(model["vocab"], key=model["vocab"].get) if t.endswith(end))
        found += [t for t in whole if 3 <= len(t) <= LONGEST_WORD and t.isascii() and t.isalpha()][:DICTIONARY_WORDS]
    return {w: i for i, w in reversed(list(enumerate(found, 1)))}


def _alphabet(text: str) -> int:
    kinds = (str.islower, 26), (str.isupper, 26), (str.isdigit, 10)
    size = sum(n for f, n in kinds if any(map(f, text)))
    return size + 33 * any(not c.isalnum() for c in text) + 100 * any(c.isalnum() and not c.isascii() for c in text)


def guess_cost(value: str, words: str | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation needs; 0 for the empty value. ``words`` is the path
    of a vocabulary."""
    return _cached_cost(value, words) if len(value) <= CACHED else _cost(value, words)


def dear(value: str, threshold: float, words: str | None = None) -> bool:
    """Does the value cost at least the threshold? A long one is read only as far as it takes to tell."""
    return (guess_cost(value, words) if len(value) <= CACHED else _cost(value, words, threshold)) >= threshold


def _cost(value: str, words: str | None = None, enough: float = math.inf) -> float:
    """The cost of the whole value, or, from ``enough`` on, a lower bound of it that reaches ``enough``.

    Every cut of the value either has a bound among the last ``_CUT`` places or covers them all by one
    span, which costs no less than its part up to here; so the least of their costs bounds the whole.
    """
    n = len(value)
    if not n:
        return 0.0
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    rank_of = ranked(words).get
    each = math.log10(max(2, _alphabet(value)))
    best = [0.0] + [math.inf] * n
    same = [1] * n
    walk = [1] * n
    for i in range(1, n):
        same[i] = same[i - 1] + 1 if value[i] == value[i - 1] else 1
        walk[i] = walk[i - 1] + 1 if (low[i - 1], low[i]) in _NEXT else 1
    dates: dict[int, list[int]] = {}
    for s in range(n):
        if m := _DATE.match(value, s):
            dates.setdefault(m.end(), []).append(s)
    brute = math.inf
    for i in range(1, n + 1):
        brute = min(brute, best[i - 1] + _PER_SEGMENT) + each
        cost = brute
        for j in range(max(0, i - LONGEST_WORD), i - 1):
            rank = rank_of(low[j:i])
            odd = 0.0 if low[j:i] == value[j:i] else 0.5
            if rank is None and (rank := rank_of(plain[j:i])) is not None:
                odd = 1.0
            if rank is not None:
                cost = min(cost, best[j] + _PER_SEGMENT + math.log10(rank + 1) + odd)
        for j in dates.get(i, ()):
            cost = min(cost, best[j] + _PER_SEGMENT + math.log10(366 * 120))
        for k in _lengths(same[i - 1]):
            cost = min(cost, best[i - k] + _PER_SEGMENT + each + math.log10(k))
        for k in _lengths(walk[i - 1]):
            cost = min(cost, best[i - k] + _PER_SEGMENT + math.log10(94 * k))
        best[i] = cost
        if enough < math.inf and i >= _CUT and (least := min(best[i - _CUT : i + 1])) >= enough:
            return least
    return best[n]


_cached_cost = lru_cache(maxsize=65_536)(_cost)


def _lengths(run: int) -> Iterable[int]:
    """Lengths of a repeat or walk that end here. In a long one only short spans and those from about its
    start count: two spans of one run never cost less than one over both."""
    return range(3, run + 1) if run <= 4 * _CUT else chain(range(3, _CUT + 1), range(run - _CUT, run + 1))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value), ordered by start and kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


_PROSE = re.compile(r"[^\W\d_]+(?:['’/-][^\W\d_]+)*")
_ADDRESS = re.compile(r"(?a)[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def plain_words(value: str, words: str | None) -> bool:
    """Letters, capital at most at the start of a part, all parts of a compound being known words. The vocabulary
    has ASCII words alone, so a part with other letters is taken for a word."""
    known = ranked(words)
    parts = re.split(r"['’/-]", value)
    return _PROSE.fullmatch(value) is not None and all(p[1:] == p[1:].lower() and (p.lower() in known or len(p) < 3 or not p.isascii()) for p in parts)


def method_spans(text: str, base: list[tuple[int, int, int, int]], threshold: float = THRESHOLD, words: str | None = None) -> list[tuple[int, int, int, int]]:
    """Values in credential contexts that no base span covers whole and that cost at least the threshold.

    A value that goes on where its base span stops, at a character that the base pattern has not, is scored and
    spanned whole. A value of known words alone is running text, and so is one of small letters where no separator
    stands before it; an e-mail address names an account. Those are no secrets, but phrases after their own names are.
    """
    found = []
    for v, e in {(v, e) for _, kind, e, v in base if kind == 0}:
        whole = v + len(_WHOLE.match(text, v)[0].rstrip(_END))
        if whole > e and dear(text[v:whole], threshold, words):
            found.append((v, 3, whole, v))
    for p in (CONTEXT, USERINFO) if "://" in text else (CONTEXT,):
        at, k = 0, 0
        while m := p.search(text, at):
            at = s = m.start("value")  # a dropped value may itself be the name before the real one
            value = m["value"].rstrip(_END)
            e = s + len(value)
            while k < len(base) and base[k][2] <= s:  # both run by start: base spans behind are done with
                k += 1
            within, j = 0, k
            while j < len(base) and base[j][0] <= s:
                within, j = max(within, base[j][2] if s < base[j][2] else 0), j + 1
            if e <= within or len(value) < 6:
                at = max(s, within - _LONGEST_NAME)
                continue
            if p is CONTEXT and (m["sep"] is None and value.isalpha() and value[1:] == value[1:].lower() or plain_words(value, words) or _ADDRESS.fullmatch(value)):
                continue
            if dear(value, threshold, words):
                found.append((s, 3, e, s))
                at = e
    found += [(m.start("value"), 3, m.end("value"), m.start("value")) for m in PHRASE.finditer(text) if dear(m["value"], threshold, words)]
    out, last = [], -1
    for span in sorted(found, key=lambda x: (x[0], -x[2])):
        if span[0] >= last:
            out.append(span)
            last = span[2]
    return out


def joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: str | None = None) -> DataFrame:
    """Per row: counts per kind, the digest of the base spans and all spans (code points, end exclusive).

    A null text is empty and has no spans. Rows keep their number; a null id stays null. ``words`` is the path
    of a vocabulary of ranked words; without one a short list of common passwords serves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = method_spans(text, base, threshold, words)
                count = [sum(k == i for _, k, _, _ in base) for i in range(3)]
                for c, v in zip(cols, (*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)), strict=True):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


MASK = "<secret>"


def redacted(text: str, threshold: float = THRESHOLD, words: str | None = None) -> str:
    """The text with the value of every span replaced by MASK."""
    base = base_spans(text)
    out, at = [], 0
    for s, e in sorted((v, e) for _, _, e, v in base + method_spans(text, base, threshold, words)):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, words: str | None = None) -> DataFrame:
    """``docs`` with the text redacted, all other columns as they are; a null text stays null."""
    kept = bounded(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [None if t is None else redacted(t, threshold, words) for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=["row", "text"])

    out = kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, text string")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
