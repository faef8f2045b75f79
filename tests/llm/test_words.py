"""Quality rules by divergence, spelling variants and collocations, held against brute-force versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewise.llm import bidirectional, collocations, divergence, spelling
from tests.llm.test_llm import DOCS, ODD, frame

COMMON = "the of and to in a is that for it was on with as be at by this are from or an".split()


# ---- 11 divergence ------------------------------------------------------------------------


def prose(rng, n, common=COMMON):
    out = []
    for i in range(n):
        word = rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("aeionrst") for _ in range(rng.randint(3, 9)))
        out.append((word.capitalize() if i % 11 == 0 else word) + (".\n" if i % 11 == 10 else " "))
    return "".join(out)


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
        len(words) < 50 or 100 * len(hit) > 50 * len(words),
    )


@pytest.fixture(scope="module")
def mixed(spark):
    """Clean English, junk of four kinds, and the odd documents with clashing columns."""
    rng = random.Random(3)
    clean = [prose(rng, rng.choice([60, 200, 500])) for _ in range(40)]
    noisy = ["".join(w + "###" + " " for w in prose(rng, 120).split()) for _ in range(3)]
    loud = [prose(rng, 120).upper().replace(" ", "!! ") for _ in range(3)]
    lists = [" | ".join("".join(rng.choice("aeionrst") for _ in range(6)) for _ in range(80)) for _ in range(3)]
    runs = ["one two three four " * 30, "\n".join(["same line here"] * 40), clean[0] * 2]
    texts = clean + noisy + loud + lists + runs
    rows = [(100 + i, t, "en", "a") for i, t in enumerate(texts)]
    rows += [(500, "\U0001f600 é\x0b# x\ty\rz |" + "\n\n \n", "xx", None), (501, clean[0], None, "b")]
    return frame(spark, rows + ODD), rows + ODD


def test_base_rules_are_those_of_the_text(mixed):
    docs, rows = mixed
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = collections.Counter((r.row.doc_id, *[r[c] for c in cols]) for r in divergence.judge(docs).collect())
    assert got == collections.Counter((i, *brute_rules(t)) for i, t, _, _ in rows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=20))
def test_repeated_windows(spark, texts):
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.i: r.n_repeat_words for r in divergence.with_rules(df).select("row.doc_id", "n_repeat_words").toDF("i", "n_repeat_words").collect()}
    assert got == {i: brute_rules(t)[4] for i, t in enumerate(texts)}


def test_clean_stays_and_junk_goes(mixed):
    docs, _ = mixed
    kept = {r.row.doc_id: r.kept for r in divergence.judge(docs).collect()}
    assert all(kept[100 + i] for i in range(40)) and kept[501]
    assert not any(kept[100 + i] for i in range(40, 52))
    back = divergence.good_documents(docs)
    assert back.columns == docs.columns and back.count() == sum(r.kept for r in divergence.judge(docs).collect())


def test_distances_are_jensen_shannon(mixed):
    docs, rows = mixed
    en = [t for _, t, lang, _ in rows if lang == "en" and len(re.findall(r"\S+", t or "")) >= 50]
    words = collections.Counter(w for t in en for w in re.findall(r"[^\W\d_]+", t.lower()))
    common = sorted(words, key=lambda w: (-words[w], w))[: divergence.COMMON_WORDS]
    ref = [words[w] for w in common] + [sum(words.values()) - sum(words[w] for w in common)]

    def distance(text):
        mine = collections.Counter(re.findall(r"[^\W\d_]+", text.lower()))
        cnt = [mine[w] for w in common] + [sum(mine.values()) - sum(mine[w] for w in common)]
        p, q = np.array(cnt) / sum(cnt), np.array(ref) / sum(ref)
        m = (p + q) / 2
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        return math.sqrt((kl(p) + kl(q)) / 2)

    got = {r.row.doc_id: r.word_distance for r in divergence.judge(docs).collect() if r.row.lang == "en"}
    for i, t, lang, _ in rows:
        if lang == "en" and i is not None and re.search(r"[a-z]", (t or "").lower()):
            assert got[i] == pytest.approx(distance(t), abs=1e-9)


def test_no_documents_no_rows(spark):
    assert divergence.judge(spark.createDataFrame([], DOCS)).count() == 0


# ---- 12 spelling --------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def zones(words, depth):
    out = []
    for i, w in enumerate(words):
        for s in (len(w), len(w) - 1):
            cuts = [(0, -(-s // 2)), (-(-s // 2), s)] if s else []
            for _ in range(depth):
                cuts = [z for lo, hi in cuts for z in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
            out += [(i, s, lo, hi) for lo, hi in cuts if lo < hi]
    return np.array(out, dtype=np.int64)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé\U0001d4d0", min_size=1, max_size=7), min_size=1, max_size=40), st.integers(0, 2), st.booleans())
def test_index_finds_each_near_word_once(words, depth, long):
    words = sorted(words | ({"a" * 70, "a" * 71, "b" + "a" * 70, "a" * 40 + "c" + "a" * 29} if long else set()))
    asked = zones(words, depth)
    q, v = bidirectional.Searcher(words).near(*asked.T)
    got = sorted((words[a], words[b]) for a, b in zip(asked[q, 0], v))
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


@pytest.mark.parametrize("most, shard_words", [(spelling.BUCKET_WORDS, spelling.SHARD_WORDS), (3, 7)])
def test_variants(spark, most, shard_words):
    rng = random.Random(5)
    counts = {}
    for stem in ("traffic", "trafficable", "crossings", "éèàçñöü"):
        for _ in range(60):
            w = list(stem)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "ff"])
            counts["".join(w)] = rng.choice([2, 3, 30, 300, 4000])
    counts |= {"z": 2, "zz": 20, "zzz": 200, "zzzz": 2000}
    rows = [(w, n - 1, "x") for w, n in counts.items()] + [(w, 1, "y") for w in counts] + [(None, 5, "z")]
    df = spark.createDataFrame(rows, "word string, n long, form string")
    got = spelling.spelling_variants(df, most=most, shard_words=shard_words).collect()
    assert {tuple(r) for r in got} == brute_variants(counts) and len(got) == len(counts)


def test_word_counts(spark):
    rows = [*ODD, (8, "STRASSENbahn straßenbahn x2straßenbahn Éclairages éclairages aaa" * 3, "fr", "a"), (9, "strassenbahn " * 99, "de", "b")]
    want = collections.Counter()
    for i, t, _, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    got = {r.word: r.n for r in spelling.word_counts(frame(spark, rows)).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


def test_no_words_no_variants(spark):
    assert spelling.spelling_variants(spelling.word_counts(spark.createDataFrame([], DOCS))).count() == 0


# ---- 13 collocations ----------------------------------------------------------------------


def brute_collocations(rows, top, least):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in (1, 2, 3):
                f.update((lang or "und", *words[i : i + m]) for i in range(len(words) - m + 1))
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = collections.defaultdict(list)
    for (lang, *w), a in cand.items():
        if any(100 * b >= 50 * a for (la, *x), b in cand.items() if la == lang and len(x) > len(w) and (x[:-1] == w or x[1:] == w)):
            continue
        cuts = [(1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return [
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    ]


@pytest.mark.parametrize("how", [{}, {"shard": 40, "slots": 64}, {"shard": 4, "slots": 4}])
def test_collocations(spark, how):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)] + ["New", "york", "são", "\x00", "a|b"]
    rows = list(ODD)
    for i in range(60):
        words = [rng.choice(vocabulary[: rng.choice([3, 17])]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for w in words) + rng.choice(["", "new York city; ", "hot pair "]) * 4
        rows.append((100 + i, text, rng.choice(["en", "en", None, "und", "é"]), "a"))
    rows.append((999, "hot pair x. " * 400, "en", "a"))
    want = brute_collocations(rows, 25, 10)
    got = [tuple(r) for r in collocations.collocations(frame(spark, rows), top=25, **how).collect()]
    assert len(want) > 30 and sorted(got) == sorted(want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=3), st.integers(1, 4)), max_size=40), st.integers(1, 12))
def test_equal_partitions_are_counts(suffixes, least):
    keys = np.array([s + [-1] * (3 - len(s)) for s, _ in suffixes], dtype=np.int64).reshape(-1, 3)
    weight = np.array([w for _, w in suffixes], dtype=np.int64)
    want = collections.Counter()
    for s, w in suffixes:
        for d in range(1, len(s) + 1):
            want[tuple(s[:d])] += w
    got = []
    for depth, at, n in collocations.partitions(keys, weight, least):
        got += [(tuple(keys[a, :d].tolist()), c) for d, a, c in zip(depth.tolist(), at.tolist(), n.tolist())]
    assert sorted(got) == sorted((k, c) for k, c in want.items() if c >= least)


def test_large_counts_are_exact(spark):
    big = 3_000_000_000_000
    rows = [("en", [], 4 * big), ("en", ["a"], big + 1), ("en", ["b"], big + 3), ("en", ["a", "b"], big)]
    df = spark.createDataFrame(rows, "lang string, words array<string>, n long")
    assert collocations.scored(df).first().score == 1000000 * big * big // ((big + 1) * (big + 3))


def test_no_texts_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.phrase_counts(frame(spark, [(1, None, None, None)])).where(F.size("words") > 0).count() == 0
