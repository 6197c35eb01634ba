"""Conversation repair, source divergence and the Jaccard join against brute force, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rillway.llm import conversations, divergence, jaccard

BLANKS = " \t\n\x0b\f\r"
CONV = "conv_id long, turn long, role string, text string"
DOC = "doc_id long, text string, lang string, source string"


# conversations ------------------------------------------------------------------------------------------
def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        log = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            log += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for log in out.values():
        log.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """(report, lines) by trying every edit of every turn, all insertions included."""
    seen, faults = set(), []
    for _, role, text in rows:
        rest = text.strip(BLANKS)
        faults.append(1 if not rest else 2 if (role, text) in seen else 3 if rest[-1] not in ".!?" else 0)
        seen.add((role, text))
    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        now = {}

        def put(state, cost, word, lines, now=now):
            if state is not None and (state not in now or (cost, word) < now[state][:2]):
                now[state] = (cost, word, lines)

        for begin, (cost, word, lines) in best.items():
            state = begin
            for _ in range(4):
                put(state, cost + 4, word + "D", lines)
                if fault not in (1, 2):
                    more = 3 if fault == 3 else 0
                    put(NEXT.get((state, role[:1])), cost + more, word + "K", (*lines, (role, text)))
                    for to in ("user", "assistant"):
                        put(NEXT.get((state, to[0])), cost + more + 3, word + "R", (*lines, (to, text)))
                to = "assistant" if state == "u" else "user"
                state, cost, word, lines = to[0], cost + 3, word + "I", (*lines, (to, ""))
        best = now
    ends = []
    for state, (cost, word, lines) in best.items():
        more = {"": (), "a": (), "u": (("assistant", ""),), "s": (("user", ""), ("assistant", ""))}[state]
        ends.append((cost + 3 * len(more), word + "I" * len(more), (*lines, *more)))
    cost, word, lines = min(ends)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, word), lines


def random_turns(seed):
    r = random.Random(seed)
    rows = [(c or None, r.choice([t, t, t, r.randrange(9), None]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ua"]), r.choice(["hi.", "a", "", " \t", None, "q?", "é!", "x\n", "hi."])) for c in range(120) for t in range(r.choice([1, 2, 3, 5, 8, 20]))]
    return rows + [(9999, t, r.choice(["user", "assistant", "system"]), r.choice(["hi.", "a", ""]) if t % 3 else f"t{t}.") for t in range(700)]


@pytest.mark.parametrize(("seed", "segment", "fan"), [(1, 256, 64), (2, 5, 3)])
def test_repairs_are_the_cheapest(spark, monkeypatch, seed, segment, fan):
    """Also where a conversation is cut into segments that are composed in several rounds; nulls, ties, repeats."""
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "FAN_IN", fan)
    rows = random_turns(seed)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_report(spark.createDataFrame(rows, CONV)).collect()}
    want = {}
    for conv, log in damaged(rows).items():
        report, lines = cheapest(log)
        want[conv] = (*report, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest())
    assert got == want


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "a."), (1, 2, "user", "b."), (1, 3, "assistant", "c."), (2, 0, "assistant", "x."), (3, 0, "user", " ")]
    report, turns = conversations.repair(spark.createDataFrame(rows, CONV).withColumn("n", F.lit("other")))
    # a third user turn is changed or left out at like cost, and D comes first
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {1: (3, "KKIKK"), 2: (3, "IK"), 3: (4, "D")}
    got = [(r.conv_id, r.edit, r.role, r.text) for r in turns.orderBy("conv_id", "n", "place").collect()]
    assert got == [(1, "keep", "system", "s."), (1, "keep", "user", "a."), (1, "insert", "assistant", ""), (1, "keep", "user", "b."), (1, "keep", "assistant", "c."), (2, "insert", "user", ""), (2, "keep", "assistant", "x.")]


def test_conversations_long_and_empty(spark):
    assert conversations.repair_report(spark.createDataFrame([], CONV)).count() == 0
    long = "word " * 400_000 + "end."
    (r,) = conversations.repair_report(spark.createDataFrame([(4, 1, "user", long), (4, 3, "assistant", long)], CONV)).collect()
    assert (r.gaps, r.blank, r.duplicate, r.cost) == (1, 0, 0, 0) and r.audit == "KK"
    assert r.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()


# divergence ---------------------------------------------------------------------------------------------
def audited(rows, top=200):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {t[0] for t in texts}:
        docs = collections.Counter(w for g, _, ws in texts if g == lang for w in set(ws))
        kept = {w for w, n in docs.items() if n >= 3}
        groups = {s: collections.Counter(w for g, x, ws in texts if (g, x) == (lang, s) for w in ws if w in kept) for g, s, _ in texts if g == lang}
        whole = sum(groups.values(), collections.Counter())
        p = lambda c, w, kept=kept: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in groups.items():
            pairs = [(x, sum(f(p(c, w), p(d, w)) for w in kept)) for x, d in groups.items() if x != s]
            terms = [(w, f(p(c, w), p(whole, w))) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(items, 1) if part == "pair" or i <= top}
    return out


def texts(seed, n=150):
    r = random.Random(seed)
    words = ["Alpha", "beta", "γάμμα", "d'elta", "x1y", "ÉTÉ", "été", "zz", "q", "--", "naïve"] + [f"w{chr(97 + i)}" for i in range(26)]
    return [(i, r.choice([None, "", " ".join(r.choices(words, k=r.randrange(30))), " ".join(r.choices(words[:12], k=9))]), r.choice(["en", "en", "de", None]), r.choice(["s1", "s2", "é", "", None])) for i in range(n)] + [(i, "only two", "fr", f"t{i}") for i in range(2)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_divergence_equals_brute_force(spark, monkeypatch, broadcast):
    """Totals broadcast or dealt; nulls, empty texts, a language without kept terms, ties, repeated rows, other columns."""
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 5_000 if broadcast else 0)
    rows = texts(3) * 2
    df = spark.createDataFrame(rows, DOC).withColumns({"term": F.lit("t"), "n": F.lit(1), "p": F.lit(None).cast("int")})
    assert {tuple(r) for r in divergence.audit(df).collect()} == audited(rows)


def test_divergence_of_few_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BATCH", 64)
    rows = texts(8, 60)
    got = divergence.audit(spark.createDataFrame(rows, DOC), top=3).collect()
    assert {tuple(r) for r in got} == audited(rows, 3) and max(r.rank for r in got if r.part == "term") == 3
    assert divergence.audit(spark.createDataFrame([], DOC)).count() == 0


def test_divergence_of_long_texts(spark):
    rows = [(i, "a" * 300_000 + " " + "b " * 200_000, "en", f"s{i % 2}") for i in range(3)]
    got = {(r.source, r.item): r.value for r in divergence.audit(spark.createDataFrame(rows, DOC)).where("part = 'pair'").collect()}
    assert got == {(s, i): v for _, s, part, i, v, _ in audited(rows) if part == "pair"}


def test_term_counts_add_up(spark):
    """One group's counts over batches are those of its texts, and arithmetic stays exact beyond a long."""
    rows = texts(5)
    got = divergence.term_counts(spark.createDataFrame(rows, DOC).repartition(5), *(F.coalesce(c, F.lit("")) for c in ("text", "lang", "source"))).groupBy("term").agg(F.sum("n").alias("n")).collect()
    want = collections.Counter(w for _, t, *_ in rows for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    assert {r.term: r.n for r in got} == dict(want)
    wide = spark.range(1).select(divergence._probability(F.lit(9 * 10**17), F.lit(10**18), F.lit(5)).alias("p")).first().p
    assert wide == 1 + 10**9 * (9 * 10**17 + 1) // (10**18 + 5)


# the join -----------------------------------------------------------------------------------------------
def shingled(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else {tuple(words)} if words else set()


def joined(rows, percent=85):
    sets = [(i, shingled(t)) for i, t in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][1] and 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1]) and sets[b][1]]
    label = list(range(len(sets)))
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    least = {}
    for k, (i, _) in enumerate(sets):
        least[label[k]] = min(i, least.get(label[k], i))
    return sorted((i, len(s), least[label[k]]) for k, (i, s) in enumerate(sets)), links, sets


def family(seed):
    """Copies, near copies about the threshold, a passage that many share, short and blank texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 8, 30, 90, 300]))]
        for _ in range(r.choice([1, 2, 6])):
            out = list(base)
            for _ in range(r.randrange(0, 1 + len(out) // 25)):
                out[r.randrange(len(out))] = word()
            rows.append(" ".join(out))
    rows += [" ".join([word() for _ in range(r.choice([5, 60]))] + passage) for _ in range(40)] + [" ".join(passage[: 36 + i % 5]) for i in range(10)]
    rows += ["", " \n", None, "one", "One", "a b c", "a  b\tc", "a b c d"] + rows[:3]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "hot"), [(1, 128), (2, 3), (3, 3)])
def test_join_equals_brute_force(spark, monkeypatch, seed, hot):
    """With small thresholds, so that shingles are ordered anew, tiles have many blocks and bitmaps are folded."""
    if hot < 128:
        for name, value in (("HOT", hot), ("BLOCK", 4), ("LEAST_BLOCK", 2), ("LOOKS", 1)):
            monkeypatch.setattr(jaccard, name, value)
    rows = family(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "id": F.lit(3), "token": F.lit(None).cast("int")})
    want, links, sets = joined(rows)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect())) == want
    pairs, member = jaccard.linked_pairs(df)
    of = dict(map(tuple, member.collect()))
    assert {tuple(p) for p in pairs.collect()} == {tuple(sorted((of[sets[a][0]], of[sets[b][0]]))) for a, b in links if of[sets[a][0]] != of[sets[b][0]]}


def test_join_of_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0
    text = " ".join(f"v{i}" for i in range(50))
    rows = [(7, text), (7, text), (None, text), (9, text + " more"), (9, "else where is this"), (None, None), (8, "an other text of two"), (6, "an other text of two"), (8, "the second of eight")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(7, 47, 7), (7, 47, 7), (None, 47, None), (9, 48, 7), (9, 1, 7), (None, 0, None), (8, 2, 6), (6, 2, 6), (8, 1, 6)], key=str)


def test_join_of_long_texts(spark):
    r = random.Random(2)
    long = [f"u{r.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-9000] + ["new"] * 9000)), (3, " ".join(long[::-1])), (4, " ".join(long[:100_000]))]
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_bitmaps_bound_the_overlap():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        both = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, rng.integers(0, 200), dtype=np.uint64)])) for _ in range(2))
        bits = [jaccard.bitmaps(x, np.array([0, len(x)]), jaccard.bitmap_bits(jaccard.bands(np.array([len(x)]), 85), 85))[0] for x in (a, b)]
        size = min(map(len, bits))
        differ = int(np.bitwise_count(jaccard.folded(bits[0], size) ^ jaccard.folded(bits[1], size)).sum())
        common = len(np.intersect1d(a, b))
        assert common <= (len(a) + len(b) - differ) // 2
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert jaccard.may_link(np.array([len(a)]), np.array([len(b)]), np.array([differ]), 85)[0] and abs(jaccard.bands(np.array([len(a)]), 85)[0] - jaccard.bands(np.array([len(b)]), 85)[0]) <= 1
