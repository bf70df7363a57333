"""Operators on documents against brute force, on odd rows: NULLs in any column, empty and very
long texts, copies, ties, repeated rows, clashing column names, and an empty table."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from scenemark.llm import exact, language, lm, mixing, pieces, secrets, simhash, tokens

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, keep bigint, digest int, key string, words string, tokens int, node int, k int, c0 int"
SECRETS = [
    "password=hunter2hunter2 x", "Secret : 'abcdefabcdef0123'", "token=token=abcdefghijklmn", "secret=token: abcdefghijklmn", "api_key=\"short\"",
    "AKIAABCDEFGHIJKLMN and AKIA1234", "deadbeefdeadbeef0 cafe", "ſecret=abcdefghijkl PASSWD:ABCDEFGHIJKLMNO", "é 0123456789abcdef0123456789abcdef é",
]


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", " ", "\n\t", "a", "A", "É", "é", "12 34", "日本語 テキスト", "x" * 200_000, text(30_000), "The End", "tHE eND", "<|endoftext|> a", "▁ ▁", "a  b \n c", "end ", "\x1c!\x1c"]
    base = text(300)
    texts += [base] * 5 + [base.upper(), base + " more"]
    for i in range(12):
        words = base.split()
        words[17 * i] = "zz"
        texts.append(" ".join(words))
    texts += SECRETS + [text(r.randint(1, 80)) for _ in range(60)]
    made = [(i * 3, t, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", "src2", None]), None, "fp", 1, 2, "key", "w", 3, 4, 5, 6) for i, t in enumerate(texts)]
    made += [made[20], made[20], (None, base, "en", "src0", 1, *made[0][5:]), (None, "only null key", None, None, None, *made[0][5:])]
    return made


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").encode().lower()


def low(x):
    return (x is not None, x if x is not None else 0)


@pytest.mark.parametrize("digits", [64, 1])
def test_exact(docs, digits):
    groups = collections.defaultdict(list)
    for r in rows():
        groups[lower(r[1])].append(r[0])
    want = collections.Counter()
    for t, ids in groups.items():
        best = max(ids, key=low)
        for i in ids:
            want[(i, best, len(ids), hashlib.sha256(t).hexdigest())] += 1
    got = exact.duplicates(docs, digits=digits).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    if digits == 64:
        assert sum(r.kept for r in got) == len(groups)
    assert all(not r.kept or r.doc_id == r.keep_id for r in got)
    kept = exact.keep_last(docs, digits=digits)
    assert kept.columns == docs.columns
    assert sorted(((r[0], lower(r[1])) for r in kept.collect()), key=str) == sorted(((max(ids, key=low), t) for t, ids in groups.items()), key=str)


def brute_print(text):
    found = lower(text).split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, key in enumerate(ids):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("block", [4096, 2])
def test_simhash(docs, block, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, simhash.PARTS, block))
    given = rows()
    prints = [brute_print(r[1]) for r in given]
    want = collections.Counter(zip([r[0] for r in given], [f"{p:016x}" for p in prints], brute_components([r[0] for r in given], prints)))
    got = simhash.near_duplicates(docs)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}


def test_simhash_links_find_all_pairs(spark):
    r = np.random.default_rng(1)
    centres = r.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:  # around every centre, prints 1 to 6 bits away
        for n in r.integers(1, 7, 60):
            prints.add(int(c) ^ sum(1 << int(b) for b in r.choice(64, n, replace=False)))
    prints = sorted(prints)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    frame = simhash.stored(spark.createDataFrame(signed, "fp long"))
    want = brute_components(list(range(len(prints))), prints)
    for block in (4096, 16):
        found = simhash.links(frame, block=block).collect()
        assert all(((x.a ^ x.b) & (2**64 - 1)).bit_count() <= 64 for x in found)
        at = {s[0]: i for i, s in enumerate(signed)}
        root = list(range(len(prints)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x in found:
            a, b = find(at[x.a]), find(at[x.b])
            root[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(prints))] == want


def test_thresholds_leave_no_gap():
    r = np.random.default_rng(2)
    sample = r.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    for parts in (2, 3, 4, 5):
        groups = [list(range(64))[i::parts] for i in range(parts)]
        for total in (100, 10**6, 10**9):
            assert sum(t + 1 for t in simhash.thresholds(sample, total, groups)) == simhash.RADIUS + 1


def test_pieces(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    by = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    for r in pieces.digests(docs.filter("doc_id IS NOT NULL"), PIECE).collect():
        ids = sp.encode(by[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    encoded = pieces.encode(docs.filter("doc_id IS NOT NULL"), PIECE)
    for r in encoded.collect():
        raw, names = by[r.doc_id].encode(), [sp.id_to_piece(i) for i in r.ids[1:-1]]
        assert len(r.bounds) == len(names) + 1 and r.bounds[-1] == len(raw)
        for name, a, b in zip(names, r.bounds, r.bounds[1:]):
            surface = raw[a:b].replace(b" ", pieces.MARK)
            one = re.fullmatch("<0x(..)>", name)
            assert surface == (bytes([int(one[1], 16)]) if one else name.encode()) or (a == 0 and pieces.MARK + surface == name.encode())
    back = {r.doc_id: r.text for r in pieces.decode(encoded.select("doc_id", "ids"), PIECE).collect()}
    assert all(back[i] == sp.decode(sp.encode(t)) for i, t in by.items())


def test_normaliser_follows_the_compiled_map():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    r = random.Random(3)
    for flags in ({"remove_extra_whitespaces": True, "add_dummy_prefix": True, "escape_whitespaces": True}, {"remove_extra_whitespaces": False, "add_dummy_prefix": False, "escape_whitespaces": False}):
        library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", **flags)
        spec = proto.NormalizerSpec()
        spec.ParseFromString(library.serialized_normalizer_spec())
        own = pieces.Normaliser(spec)
        for _ in range(1000):
            text = "".join(r.choices("ab  ①ﬁ㍿ｱﾞé\t\n　Ａ²½​▁", k=r.randint(0, 10)))
            normal, source = own(text.encode())
            assert normal.decode() == library.normalize(text)
            assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())


def test_segments_equal_whole_texts():
    r = random.Random(4)
    byte, piece = tokens.load(BYTE), pieces.load(PIECE)
    for _ in range(5000):
        text = "".join(r.choices("ab '\n\t .,!1é▁日　 \x1c sS", k=r.randint(0, 14)))
        assert byte.encode(text) == byte.whole(text), text
        assert piece.encode(text) == tokens.pack(piece.sp.encode(text)), text


def test_token_count_query(spark, small):
    """The whole query: everything once by bytes, what is not English again by pieces."""
    import sentencepiece
    from tokenizers import Tokenizer

    from scenemark.llm.queries import QUERIES

    byte, piece = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = collections.defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        english = r.lang == "en"
        n = len(byte.encode(r.text or "", add_special_tokens=False).ids) if english else len(piece.encode(r.text or ""))
        key = (r.source, r.lang, "byte_bpe_50k" if english else "piece_bpe_32k")
        want[key][0] += 1
        want[key][1] += n
    got = {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in QUERIES["op1_token_counts"](spark, small).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, tmp_path, encoding):
    from pyarrow import parquet
    from tokenizers import Tokenizer

    library, folder = Tokenizer.from_file(BYTE), str(tmp_path / encoding)
    tokens.write(docs, folder, BYTE, encoding=encoding)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.checksums(spark, folder).collect()))
    order = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (low(r[0]), r[1].encode()))
    start = 0
    for (at, doc, n, crc), (key, text) in zip(got, order, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        assert (at, doc, n, crc) == (start, key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = tokens.read(spark, folder, first=30, last=60).select("doc_id").collect()
    assert sorted(r.doc_id for r in some) == sorted(r[0] for r in rows() if r[0] is not None and 30 <= r[0] <= 60)
    used = {e for f in (tmp_path / encoding).glob("*.parquet") for g in range(parquet.ParquetFile(f).num_row_groups) for e in parquet.ParquetFile(f).metadata.row_group(g).column(4).encodings}
    assert ("DELTA_BINARY_PACKED" in used) == (encoding == "delta") and ("RLE_DICTIONARY" in used or "PLAIN_DICTIONARY" in used) == (encoding == "dictionary")
    meta = next(f for f in (tmp_path / encoding).glob("*.parquet") if parquet.ParquetFile(f).num_row_groups)
    assert parquet.ParquetFile(meta).metadata.row_group(0).column(0).has_column_index


def test_language(docs):
    plain = {r[0]: r[1] for r in rows()}
    got = language.identify(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        letters = any(c.isalpha() for c in plain[r.doc_id] or "") if r.doc_id is not None else True
        assert (r.lang_pred in ("en", "de")) if letters else (r.lang_pred == "und" and r.score == 0 and not r.accepted)
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 3 == 1)
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.accepted for r in got)


def test_language_held_out_accuracy(spark, small):
    got = {r.doc_id: r for r in language.identify(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    held = [(r.lang, got[r.doc_id]) for r in spark.read.parquet(f"{small}/documents.parquet").collect() if got[r.doc_id].held_out]
    assert sum(lang == g.lang_pred for lang, g in held) >= 0.95 * len(held)
    # a hand-made vector search gives the same answers: labels never enter a prediction
    wiped = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id % 2 = 0")
    model = language.fit(spark.read.parquet(f"{small}/documents.parquet").filter(~language._held_out("doc_id")))
    for r in wiped.collect():
        assert model.predict(r.text)[:2] == (got[r.doc_id].lang_pred, got[r.doc_id].score)


def test_grams_of_long_texts_come_in_pieces(monkeypatch):
    text = "Ein längerer Text, mit 12 Wörtern. " * 40
    whole = language.grams(text)
    monkeypatch.setattr(language, "STEP", 7)
    parts = language.grams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_secrets(docs):
    import re

    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    kinds = [("assign", f"({names})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    want = collections.Counter()
    for r in rows():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in re.finditer(p, r[1] or "") if len(m[g]) >= n)
        line = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        want[(r[0], *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(line.encode()).hexdigest())] += 1
    got = secrets.scan(docs).collect()
    assert collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    for r in got:
        base = [s for s in r.spans.split(",") if s and "_like" not in s]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_grammars_find_unlabelled_credentials(spark):
    r = random.Random(9)
    pick = lambda chars, n: "".join(r.choices(chars, k=n))
    key = lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
    word = lambda: pick("abcdefghijklmnopqrstuvwxyz", r.randint(3, 18))
    texts = [" ".join([word(), key(), word(), word()]) for _ in range(300)]
    hidden = ["ASIA" + key()[4:] for _ in range(40)]
    texts += [f"{word()} {h} {word()}" for h in hidden] + [" ".join(word() for _ in range(20)) for _ in range(200)]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    by = {x.doc_id: x for x in got}
    assert sum(by[300 + i].n_like == 1 for i in range(40)) >= 36
    assert sum(by[340 + i].n_like for i in range(200)) == 0


def test_automaton_is_a_distribution():
    words = ["a1", "a1a1", "a1a1a1", "a1", "a1a1"] * 20
    made = secrets.infer(words)
    assert len(made.count) <= 4  # the loop is found
    assert made.loglik("a1a1a1a1") > made.loglik("aa11aa11")


def test_mix(docs):
    levels = {"lang": mixing.F.col("lang"), "source": mixing.F.col("source")}
    weights = {"en": 3, "de/src0": 2, "(null)/src1": 0}
    for share, epochs in ((0.3, 1), (0.9, 1), (1.4, 3)):
        got = mixing.mix(docs, levels, weights, share, epochs).collect()
        have = collections.defaultdict(lambda: [0, 0])
        for r in rows():
            leaf = have[(r[2] or "(null)", r[3] or "(null)")]
            leaf[0] += len((r[1] or "").encode().split())
            leaf[1] += 1
        used = collections.Counter()
        for r in got:
            used[(r.lang, r.source)] += r.used
        want = brute_budgets({k: v[0] for k, v in have.items()}, weights, share, epochs)
        assert all(abs(used[k] - want[k]) <= 1 for k in have), (used, want)
        for r in got:
            assert 0 <= r.used <= r.tokens
    kept = mixing.keep_mixed(docs, levels, weights, 0.3)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in mixing.mix(docs, levels, weights, 0.3).collect()}


def brute_budgets(leaves, weights, share, epochs):
    """The same division by repeated rounds of sharing out."""
    w = lambda path: float(weights.get("/".join(path), 1.0))
    cap = {k: v * epochs if w(k[:1]) and w(k) else 0 for k, v in leaves.items()}

    def share_out(budget, caps, weight):
        out, open_ = dict.fromkeys(caps, 0.0), {k for k in caps if weight[k] > 0}
        while budget > 1e-9 and open_:
            total, given = sum(weight[k] for k in open_), 0.0
            for k in sorted(open_):
                more = min(budget * weight[k] / total, caps[k] - out[k])
                out[k] += more
                given += more
            budget -= given
            open_ = {k for k in open_ if caps[k] - out[k] > 1e-9}
        return out

    tops = collections.defaultdict(float)
    for k, v in cap.items():
        tops[k[0]] += v
    top = share_out(min(math.floor(sum(leaves.values()) * share), sum(cap.values())), tops, {k: w((k,)) for k in tops})
    out = {}
    for k, b in top.items():
        own = {leaf: c for leaf, c in cap.items() if leaf[0] == k}
        out |= share_out(b, own, {leaf: w(leaf) for leaf in own})
    return {k: math.floor(v + 1e-6) for k, v in out.items()}


def test_lm(docs):
    got = lm.score(docs).collect()
    words = [(r[0], [*lower(r[1]).split(), None]) for r in rows()]
    train = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 != 0
    count = collections.Counter(w for i, ws in words if train(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = collections.Counter((i, not train(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in words)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_predictive_is_a_distribution():
    r = np.random.default_rng(3)
    words, leaves = 50, 32
    far = leaves // lm.NEAR
    count = np.where(r.random(words * leaves) < 0.4, 0, r.zipf(1.6, words * leaves) % 5000).astype(np.int64)
    state = lm.Seating(np.arange(words * leaves), count, leaves)
    g = lm.Globals(np.array(state.totals()))
    logs = [lm.stirling(lm.EXACT, d) for d in g.discounts]
    for _ in range(3):
        state.sweep(g, logs, r)
        fresh = lm.Globals(np.array(state.totals()), g.discounts)
        for a, b in zip((*g.customers, *g.tables), (*fresh.customers, *fresh.tables)):
            assert np.allclose(a, b)
        assert (state.t2 <= state.count).all() and (state.t1 <= state.c1).all() and (state.t0 <= state.c0).all()
        p = state.predictive(g)
        known = np.bincount(state.word, count) > 0
        root = lm.Seating._blend(0, 0, g.customers[0][0], g.tables[0][0], g.discounts[0], g.base)
        for u in range(leaves):
            mid = lm.Seating._blend(0, 0, g.customers[1][u // far], g.tables[1][u // far], g.discounts[1], root)
            unknown = lm.Seating._blend(0, 0, g.customers[2][u], g.tables[2][u], g.discounts[2], mid)
            assert abs(p[(state.leaf == u) & known[state.word]].sum() + unknown - 1) < 1e-9


def test_lm_predictive_by_recursion():
    """The columns of a seating against restaurants as dictionaries, over sparse pairs."""
    r = np.random.default_rng(4)
    words, leaves = 40, 64
    far = leaves // lm.NEAR
    pairs = np.sort(np.unique(np.concatenate((np.arange(words) * leaves, r.integers(0, words * leaves, 300)))))
    state = lm.Seating(pairs, r.integers(0, 6, len(pairs)), leaves)
    g = lm.Globals(state.totals())
    state.sweep(g, [lm.stirling(lm.EXACT, d) for d in g.discounts], r)
    seats = collections.defaultdict(dict)  # restaurant -> word -> (customers, tables)
    for pair, c, t in zip(pairs.tolist(), state.count.tolist(), state.t2.tolist()):
        seats[2, pair % leaves][pair // leaves] = (c, t)
    for level, parent in ((2, lambda u: (1, u // far)), (1, lambda u: (0, 0))):
        tables = collections.defaultdict(int)
        for (at, u), dishes in list(seats.items()):
            for w, (_, t) in dishes.items() if at == level else ():
                tables[parent(u), w] += t
        own = {1: {(int(k), int(w)): int(t) for k, w, t in zip(state.near, state.mid_word, state.t1)}, 0: {(0, w): int(t) for w, t in enumerate(state.t0)}}[level - 1]
        for ((at, u), w), c in tables.items():
            seats[at, u][w] = (c, own[u, w])

    def probability(level, u, w):
        if level < 0:
            return 1 / (g.v + 1)
        dishes, d = seats[level, u], g.discounts[level]
        c, t = dishes.get(w, (0, 0))
        all_c, all_t = sum(x for x, _ in dishes.values()), sum(x for _, x in dishes.values())
        up = probability(level - 1, u // far if level == 2 else 0, w)
        return (c - d * t + (lm.STRENGTH + d * all_t) * up) / (lm.STRENGTH + all_c)

    assert np.allclose(state.predictive(g), [probability(2, x % leaves, x // leaves) for x in pairs.tolist()], rtol=1e-12)


def test_lm_contexts_are_words():
    words = [f"w{i}x" for i in range(40)]  # one class by their last bytes would not tell these apart
    texts = [lm.word_ids(f"{w} same".encode()) for w in words]
    ids = np.concatenate(texts)
    first = np.arange(0, len(ids), 3)
    leaf = lm.contexts(ids, first, 1 << 16)
    assert len(set(leaf[1::3].tolist())) == 40 and len(set(leaf[2::3].tolist())) == 1 and set(leaf[first].tolist()) == {0}
    assert lm.restaurants(0) == 16 and lm.restaurants(10**8) == 1 << 14 and lm.restaurants(10**12) == 1 << 20


def test_lm_twice_seen_texts_and_longer_chains(spark, monkeypatch):
    """Texts that occur twice are likelier than others of the same words, and twice as many
    sweeps leave the held-out score where it is."""
    r = random.Random(5)
    vocabulary = [f"{chr(97 + i % 26)}{i}{chr(97 + i % 7)}" for i in range(400)]
    texts = [" ".join(r.choices(vocabulary, k=60)) for _ in range(400)]
    docs = spark.createDataFrame([(i, texts[i % 380]) for i in range(400)], "doc_id bigint, text string")
    got = {x.doc_id: x for x in lm.score(docs).collect()}
    seen = lambda i: not got[i].held_out
    twice = [got[i].score for i in range(20) if seen(i) and seen(i + 380)]
    once = [got[i].score for i in range(20, 380) if seen(i)]
    assert min(twice) > max(once)
    monkeypatch.setattr(lm, "BURN", 4)
    monkeypatch.setattr(lm, "SAMPLES", 6)
    longer = sum(x.score for x in lm.score(docs).collect() if x.held_out)
    assert abs(longer / sum(x.score for x in got.values() if x.held_out) - 1) < 0.005


def test_lm_table_draws_follow_the_conditional():
    theta, d, other, p, c = 1.0, 0.6, 4.0, 0.2, 5
    log = lm.stirling(lm.EXACT, d)
    drawn = lm.draw_tables(np.full(40_000, c), np.full(40_000, p), np.full(40_000, other), theta, d, log, np.random.default_rng(1))
    weight = np.array([math.exp(log[c, t] + sum(math.log((theta + d * (other + k)) * p) for k in range(t))) for t in range(1, c + 1)])
    assert np.abs(np.bincount(drawn, minlength=c + 1)[1:] / 40_000 - weight / weight.sum()).max() < 0.01


def test_lm_beats_single_words_where_order_matters(spark):
    r = random.Random(2)
    nouns, verbs = [f"n{chr(97 + i)}{chr(97 + j)}on" for i in range(6) for j in range(6)], [f"v{chr(97 + i)}{chr(97 + j)}ed" for i in range(6) for j in range(6)]
    texts = [" ".join(w for _ in range(20) for w in (r.choice(nouns), r.choice(verbs))) for _ in range(300)]
    got = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    sums = got.filter("held_out").agg({"base_score": "sum", "score": "sum"}).first()
    assert sums["sum(score)"] > sums["sum(base_score)"] + 100


def test_empty_table(empty, spark, tmp_path):
    levels = {"lang": mixing.F.col("lang")}
    for made in (
        exact.duplicates(empty), exact.keep_last(empty), simhash.near_duplicates(empty), simhash.keep_one(empty), pieces.digests(empty, PIECE), pieces.encode(empty, PIECE),
        language.identify(empty), language.keep_known(empty), secrets.scan(empty), mixing.mix(empty, levels, {}, 0.5), mixing.keep_mixed(empty, levels, {}, 0.5), lm.score(empty),
        tokens.count(empty, BYTE, ["lang"]),
    ):
        assert made.count() == 0
    tokens.write(empty, str(tmp_path / "none"), BYTE)
    assert tokens.checksums(spark, str(tmp_path / "none")).count() == 0
