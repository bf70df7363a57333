"""Lines, resampling and phrases against brute force, on odd rows: NULLs in any column, empty and very
long texts, ties, repeated rows, clashing column names, and an empty table."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from scenemark.llm import lines, phrases, resample

SCHEMA = "doc_id bigint, text string, lang string, score double, rank string, key int, run int, word int, line string, pos int, shard int, gone int, t1 int, h1 int"
EXTRA = (0.5, "rank", 1, 2, 3, "line", 4, 5, 6, 7, 8)


def made():
    r = random.Random(11)
    word = lambda: r.choice(["the", "of", "ABC", "été", "日本", "x1", "zz-zz", "İ"]) if r.random() < 0.7 else "".join(r.choices("abcdefg", k=3))
    text = lambda n: " ".join(word() + r.choice(["", "", "", ",", ".", "  ", "\t", "\n", "!\r\n"]) for _ in range(n))
    common = ["A common line of text, twice.", "  a COMMON line of text, twice.\t", "Another line that many documents share \x0b"]
    texts = [None, "", " ", "\n", "\n\n", "short\nshort\nshort", common[0], common[0] + "\n" + common[1], "é" * 20, "É" * 20, "é" * 20 + "\n", "\x0c" + "é" * 20, "é" * 19 + "\n" + "é" * 19]
    texts += ["\n".join(r.choice(common + ["x", "", "unique line number %d of this" % i]) for _ in range(r.randint(1, 150))) for i in range(40)]
    texts += ["日" * 20, "日" * 19, "日" * 20 + " ", " " + "日" * 20 + "\n" + "日" * 20]
    texts += [text(r.randint(1, 200)) for _ in range(60)] + [text(30_000), "the of " * 2000, "q" * 100_000, ";".join("ab" for _ in range(3000)), "a\x1cb a\x1cb \x85 \xa0 the"]
    rows = [(i * 7 % 1009, t, r.choice(["en", "en", "de", None, "und"]), *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], (rows[31][0], rows[32][1], "en", *EXTRA), (None, rows[33][1], None, *EXTRA), (None, None, None, *[None] * 11), (5000, common[0], "en", *EXTRA)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def first(key):
    return (key is not None, key or 0)


# --- lines ------------------------------------------------------------------------------------


def brute_lines(rows, least_docs=3):
    key = lambda line: low(line).strip(" \t\x0b\x0c\r\n")
    holders = collections.defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    last = {k: max(d, key=first) for k, d in holders.items() if len(d) >= least_docs}
    out = collections.Counter()
    for doc, text, *_ in rows:
        given = (text or "").split("\n")
        kept = [x for x in given if key(x) not in last or last[key(x)] == doc]
        out[(doc, len(given), len(given) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("least", [3, 1])
def test_lines(docs, least):
    got = lines.deduplicated(docs, least_docs=least)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert collections.Counter(map(tuple, got.collect())) == brute_lines(made(), least)
    sums = {tuple(r) for r in lines.digests(docs, least_docs=least).collect()}
    assert sums == {(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_lines(made(), least)}


def test_lines_of_one_key_over_many_runs(spark):
    """A line in all documents, several times in most, and long texts: more runs than other lines."""
    rows = [(i, "\n".join(["the line that is everywhere"] * (1 + i % 3) + [f"own {i}"] * (300 if i == 77 else 1))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert lines.sorted_runs(lines.occurrences(df)).select("run").distinct().count() > 3
    assert collections.Counter(map(tuple, lines.deduplicated(df).collect())) == brute_lines(rows)


def test_bitmaps_hold_only_words_with_a_dropped_line(spark):
    rows = [(i, "\n".join([f"a line of document {i} number {k}" for k in range(200)] + ["the line that is everywhere"])) for i in range(3)]
    maps = lines.keep_bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(m.key, tuple(map(tuple, m.gone))) for m in maps} == {(i, ((200 // 64, 1 << 200 % 64),)) for i in (0, 1)}


def test_lines_plan_is_native(docs):
    plan = lines.digests(docs)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


# --- resampling -------------------------------------------------------------------------------


def brute_weights(rows, target, longest=1, buckets=10_000):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = lambda w: [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = collections.Counter(bucket(g) for r in rows for g in grams(cut(r[1])))
    t = collections.Counter(bucket(g) for x in target for g in grams(cut(x)))
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for doc, text, *_ in rows:
        words = cut(text)
        found = [gain(bucket(g)) for g in grams(words)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    return out


TARGET = ["The of abc, the", None, "", "x1 x1 " * 50, "日本 été"]


@pytest.mark.parametrize("longest,percent,segments", [(1, 10, None), (1, 100, 50), (2, 55, 1)])
def test_resample(spark, docs, longest, percent, segments):
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    want = brute_weights(made(), TARGET, longest)
    able = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    drawn = able[: percent * len(able) // 100]
    rows = resample.resample(docs, target, longest=longest, percent=percent, segments=segments).collect()
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in rows) == collections.Counter(w[:4] for w in want)
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(w[0], w[3]) for w in drawn]


def test_ranks_with_ties(spark):
    """One score holds most rows; keys are texts; every segment is used."""
    r = random.Random(3)
    rows = [(f"k{r.randint(0, 10**6)}", 5 if r.random() < 0.8 else r.randint(0, 9)) for _ in range(5000)] + [(None, 5), (None, 9)]
    df = spark.createDataFrame(rows, "key string, score bigint").repartition(6)
    got, n = resample.ranked(df, 16)
    want = sorted(rows, key=lambda x: (-x[1], x[0] is None, x[0] or ""))
    out = sorted(got.collect(), key=lambda x: x["rank"])
    assert n == len(rows) and [(x.key, x.score) for x in out] == want and [x["rank"] for x in out] == list(range(1, n + 1))


def test_windows_lose_no_word():
    r = random.Random(2)
    for _ in range(200):
        raw = "".join(r.choice(["a", "Bc", " ", "-", "é", "0"]) for _ in range(r.randint(0, 60))).encode()
        want = raw.translate(resample.TABLE).split()
        for size in (1, 2, 7, 100):
            assert [w for part in resample.windows(raw, size) for w in part.split()] == want


# --- phrases ----------------------------------------------------------------------------------


def brute_phrases(rows, least, top=2000, cover=50):
    f, sides, n = collections.Counter(), collections.defaultdict(lambda: [0, 0]), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", low(text)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    gram = (lang, *w[i : i + k])
                    f[gram] += 1
                    sides[gram][0] += i > 0
                    sides[gram][1] += i + k < len(w)
    frequent = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    found = collections.defaultdict(list)
    for g, a in frequent.items():
        lang, words = g[0], g[1:]
        if any(100 * b >= cover * a for h, b in frequent.items() if len(words) == 2 and len(h) == 4 and h[0] == lang and words in (h[1:3], h[2:4])):
            continue
        cuts = [(10**6 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])], *sides[g]))
    return {
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s, before, after)
        for lang, c in found.items() for i, (s, a, p, l, r, before, after) in enumerate(sorted(c)[:top])
    }


@pytest.mark.parametrize("least,shard,top", [(10, phrases.SHARD, 2000), (2, 40, 2000), (3, 700, 5)])
def test_phrases(docs, least, shard, top):
    want = brute_phrases(made(), least, top)
    got = phrases.collocations(docs, least, top, shard=shard).collect()
    assert len(got) == len(want) > 10 and set(map(tuple, got)) == want


def test_index_extends_like_the_text():
    """Every interval's size is the number of occurrences, whatever the order of rows of equal context."""
    r = np.random.default_rng(4)
    ids = np.append(r.integers(0, 5, 400), 0)
    behind, ahead = phrases.transforms(ids)
    at = phrases.Index(np.bincount(ids, minlength=5), ahead, behind)
    on, back, size = at.words()
    grams = {(w,): (on[w], back[w], size[w]) for w in range(1, 5)}
    twos = [g for g in ((x, y) for x in range(1, 5) for y in range(1, 5))]
    joined = dict(zip(twos, zip(*at.joined(np.array([x for x, _ in twos]), np.array([y for _, y in twos])))))
    onwards = sorted(range(len(ids)), key=lambda i: [ids[(i + k) % len(ids)] for k in range(3)])
    for depth in (1, 2):
        heads = [g for g in grams if len(g) == depth]
        which, word, *place = at.extend(*[np.array([grams[g][i] for g in heads]) for i in range(3)])
        grams.update({(*heads[i], int(w)): (a, b, c) for i, w, a, b, c in zip(which, word, *place)})
    assert all(tuple(joined[g]) == tuple(map(int, grams[g])) for g in twos)
    for g, (a, b, c) in grams.items():
        assert c == sum(tuple(ids[i : i + len(g)]) == g for i in range(len(ids)))
        assert all(tuple(ids[(onwards[i] + k) % len(ids)] for k in range(len(g))) == g for i in range(a, a + c))


def test_sequences_in_windows():
    r = random.Random(2)
    for _ in range(300):
        raw = "".join(r.choice(["a", "Bc", " ", "\t", ".", "\n", "é", "-"]) for _ in range(r.randint(0, 60))).encode()
        want = [w for p in re.split(rb"[.,;:!?\n-\r]", raw) if (ws := re.findall(rb"[^ \t]+", p.lower())) for w in [*ws, b"\n"]]
        for size in (1, 3, 20, 1000):
            words = phrases.Words()
            ids = phrases.sequence(raw, words, size)
            names = {i: w for w, i in words.items()}
            assert [names[i] for i in ids.tolist()] == want


def test_score_is_exact(spark):
    a, left, right = 9_999_999_999_999, 10_000_000_000_000, 99_999_999_999_989
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert df.select(phrases.score(df.a, df.l, df.r)).first()[0] == 10**6 * a * a // (left * right)


def test_empty(spark, empty, docs):
    assert lines.digests(empty).collect() == []
    assert phrases.collocations(empty).collect() == []
    target = spark.createDataFrame([], "text string")
    assert resample.resample(empty, target).collect() == []
    assert resample.resample(docs, target).count() == docs.count()
