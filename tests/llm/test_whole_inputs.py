"""Short, odd and very long inputs of the operators, and runs beside each other."""

import hashlib
import random
import time

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

import corpus_pipeline
from scenemark.llm import language, pieces, secrets, tokens
from scenemark.llm.segments import DOUBLE
from scenemark.session import scratch_of, stored

ODD = ["", None, "a", "  ", "a ", "\n", "x\n\ny", "a \nb", "é à", " lead", "tab\there", "<|endoftext|> x", "a\x1c b", "日本 語。", "a  b", "don't stop.", "x y", "…", "end\n", "a.b.,", "²½ Ⅷ"]


def test_batches_of_texts_equal_the_library():
    model = tokens.ByteTokens(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    texts = ODD + ["".join(r.choices("ab '\n\t .,!1é▁日　 \x1c sS", k=r.randint(0, 14))) for _ in range(3000)] + ["word, " * 40_000]
    want = [model.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (40, 1 << 24):
        held = tokens.slices(pa.array(texts), most)
        assert sum(map(len, held)) == len(texts)
        made = [model.encode_all(s, tokens.pack([0])) for s in held]
        assert [i for _, ids in made for i in ids.tolist()] == [i for ids in want for i in [*ids, 0]]
        assert [n for sizes, _ in made for n in sizes.tolist()] == [len(ids) + 1 for ids in want]
        assert [n for s in held for n in model.sizes(s).tolist()] == [len(ids) for ids in want]
    assert tokens.slices(pa.array([], pa.string())) == []


def test_words_in_columns_equal_the_library():
    """Words are given to the model once while they are held; dropping them, at any size, changes no id."""
    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    words = ["".join(r.choices("abcdeéñß日語", k=r.randint(1, 9))) for _ in range(400)] + ["", "x1", "\nab", "don't", "a" * 500]
    texts = [" ".join(r.choice(words) + r.choice(["", "", ",", ".'", "…", "))"]) for _ in range(r.randint(0, 60))) for _ in range(300)] + ODD
    library = tokens.ByteTokens(path).library
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (0, 1, 30, 600_000):
        model, asked = tokens.ByteTokens(path), []
        model.lookup = tokens.Lookup(lambda w, m=model, asked=asked: asked.append(w) or (m._word(w) if w.isalpha() else b""), most)
        for again in range(2):
            for kind in (pa.string(), pa.large_string()):
                made = [model.encode_all(s, tokens.pack([0])) for s in tokens.slices(pa.array(texts, kind), 2000)]
                assert [i for _, ids in made for i in ids.tolist()] == [i for ids in want for i in [*ids, 0]]
                assert [n for sizes, _ in made for n in sizes.tolist()] == [len(ids) + 1 for ids in want]
                assert [n for s in tokens.slices(pa.array(texts, kind), 2000) for n in model.sizes(s).tolist()] == [len(ids) for ids in want]
        assert len(model.lookup.words) == len(model.lookup.ids) == len(model.lookup.uses)
        assert most < 600_000 or len(asked) == len(set(asked)) == len(model.lookup.words)


def test_white_space_in_runs_is_found_as_python_finds_it():
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["\ufeff", "\U0001f600"]
    found = pc.match_substring_regex(pa.array([f"a{c}{c}b" for c in chars]), tokens.SPACES).to_pylist()
    assert found == [c.isspace() for c in chars] == [bool(DOUBLE.search(f"a{c}{c}b")) for c in chars]


def test_letters_are_letters():
    for text in ("²", "½", "①", "Ⅷ", "_", "12", "", None, "² ½"):
        assert not language.has_letter(text)
    for text in ("a", "²a", "é", "日", "① x"):
        assert language.has_letter(text)


def test_short_texts_of_a_known_language_are_accepted(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.fit(docs.filter(~language._held_out("doc_id")))
    assert model.predict("Ⅷ ²") == ("und", 0.0, False)
    r = random.Random(3)
    texts = [x.text.split() for x in docs.filter("lang IS NOT NULL AND text IS NOT NULL").collect()]
    for n in (1, 2):
        cut = [" ".join(w[at : at + n]) for w in texts if len(w) > n for at in [r.randrange(len(w) - n)]]
        cut = [t for t in cut if sum(c.isalpha() for c in t) >= 2]
        assert sum(model.predict(t)[2] for t in cut) >= 0.97 * len(cut)


def pick(r, chars, n):
    return "".join(r.choices(chars, k=n))


def test_credentials_around_a_base_span(spark):
    """A run that a base span touches is a candidate; what lies inside a base span is not added."""
    r = random.Random(11)
    key = lambda: f"AKZq9-{pick(r, '0123456789abcdef', 18)}-{pick(r, 'XYZLM', 2)}{pick(r, '0123456789', 6)}"
    word = lambda: pick(r, "abcdefghijklmnopqrstuvwxyz", r.randint(3, 14))
    texts = [f"{word()} token={key()} {word()} {word()}" for _ in range(300)]
    texts += [f"{word()} {key()} {word()}" for _ in range(40)] + [f"{word()} {pick(r, '0123456789abcdef', 32)}" for _ in range(40)]
    by = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i in range(300, 340):
        assert by[i].n_hex == 1
    whole = [f"assign_like:{t.index('AKZq9')}:{t.index('AKZq9') + 33}" in by[i].spans for i, t in enumerate(texts) if 300 <= i < 340]
    assert sum(whole) >= 36
    assert all(by[i].n_like == 0 for i in range(340, 380))


def test_ordinary_runs_are_counted_over_all(spark):
    """A format that one run in two thousand has is as ordinary as it is frequent."""
    r = random.Random(12)
    words = [pick(r, "abcdefghijklmnopqrstuvwxyz", 14) for _ in range(1999)] + ["ORDER-2024-000017-X"]
    counts = secrets.transitions(words)
    made = secrets.from_transitions({int(c): int(n) for c, n in enumerate(counts) if n})
    assert counts.sum() == sum(len(w) + 1 for w in words)
    assert made.loglik("ORDER-2024-000018-X") > made.loglik("QRDRR+2024/000018/9")
    some = secrets.transitions(["a1", "a"])
    assert {int(c): int(n) for c, n in enumerate(some) if n} == {
        11 * 1728 + 11 * 144 + 11 * 12 + 0: 2, 11 * 1728 + 11 * 144 + 0 * 12 + 4: 1, 11 * 1728 + 0 * 144 + 4 * 12 + 11: 1, 11 * 1728 + 11 * 144 + 0 * 12 + 11: 1,
    }


def test_a_run_of_a_megabyte(spark):
    start = time.time()
    automata = {0: secrets.infer([f"ab{i:010}" for i in range(0, 10**9, 10**7)]), -1: secrets.from_transitions({})}
    assert len(secrets.likely(automata, "ab0123456789-" * 80_000)) == 80_000
    assert time.time() - start < 120


def test_decoded_digests(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = list(enumerate(ODD))
    got = {x.doc_id: x for x in pieces.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), path).collect()}
    sp = pieces.load(path).sp
    for i, text in rows:
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(sp.encode(text or "")).encode()).hexdigest()


def test_runs_beside_each_other_keep_their_tables(spark, small):
    """Scratch tables belong to the run that made them."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    with scratch_of() as outer:
        mine = stored(docs.select("doc_id"), "mine")
        with scratch_of() as inner:
            stored(docs.select("doc_id"), "theirs")
    assert len(inner) == 1 and len(outer) == 2
    stages = dict(corpus_pipeline.STAGES)
    one = stages["exact dedup"](spark, docs, small)
    corpus_pipeline.run(spark, small).count()
    assert one.count() and mine.count() == docs.count()


def test_op10_reads_texts_in_small_batches(spark, monkeypatch):
    """No more than ``TEXTS`` texts are on their way to Python at once, and the session's own
    setting is back afterwards."""
    from scenemark.llm import lm

    name, made = "spark.sql.execution.arrow.maxRecordsPerBatch", lm._chunks

    def checked(*args):
        run = made(*args)

        def only(batches):
            for batch in batches:
                if batch.num_rows > 7:
                    raise ValueError(f"{batch.num_rows} texts at once")
                yield batch

        return lambda batches: run(only(batches))

    monkeypatch.setattr(lm, "_chunks", checked)
    monkeypatch.setattr(lm, "TEXTS", 7, raising=False)
    before = spark.conf.get(name, None)
    docs = spark.createDataFrame([(i, "some words of a text " * (i % 5)) for i in range(60)], "doc_id long, text string").coalesce(1)
    rows = lm.score(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(60)) and spark.conf.get(name, None) == before


def test_op10_frequent_words_are_merged_in_parts(spark):
    """A frequent word's pairs come from every chunk: no merged row holds those of all chunks, and
    the scores are the same as of whole buckets."""
    import random

    from scenemark.llm import lm

    r = random.Random(5)
    texts = [" ".join(w for _ in range(40) for w in ("the", f"w{r.randint(0, 300)}")) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (7, texts[7])], "doc_id long, text string").repartition(12)
    chunks = lm._chunked(docs, "doc_id", None, 3, 1 << 10)
    of_rows = lambda n: [sum(len(x) // 4 for x in row.places) for row in lm.merged_rows(chunks, 3, 1 << 10, n)[0].collect()]
    whole, parts = of_rows(lm.ENTRIES), of_rows(400)
    assert sum(whole) == sum(parts) and len(whole) == 3 and max(parts) < max(whole) / 2
    found = [sorted(map(repr, lm.score(docs, buckets=3, leaves=1 << 10, entries=n).collect())) for n in (lm.ENTRIES, 400)]
    assert len(found[0]) == 122 and found[0] == found[1]
