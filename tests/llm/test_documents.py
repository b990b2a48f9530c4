"""Operators on documents against plain versions, on texts with nulls, ties, repeats, long and empty rows."""

import base64
import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorum.llm import byte_bpe, hashing, line_dedup, ngram_join, packing, simhash, suffix_dedup, token_counts, toxicity
from sonorum.llm.tokens import byte_encoder, word_encoder

SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    random.seed(7)
    words = ["alpha", "Beta", "gämma", "δelta", "it's", "x²", "12", "你好", "é"]
    base = [" ".join(random.choices(words, k=random.randint(1, 150))) for _ in range(8)]
    out = []
    for i in range(120):
        b = random.choice(base).split(" ")
        for _ in range(random.randint(0, 3)):
            b[random.randrange(len(b))] = random.choice("xyzwv")
        out.append((i, " ".join(b) + random.choice(["", "\nShared LINE ", "\n shared line\t", "\n\n"])))
    return [*out, (900, None), (901, ""), (None, base[0]), (None, "only here"), (5, out[5][1]), (902, " \t\n"), (903, "long " * 6000), (904, "x" * 3000), (905, "\x00\x01 <|endoftext|> a\x85b\xa0c")]


def test_jaccard(spark, rows):
    for kw in ({"rare": 3}, {"rare": 2, "frequent_limit": 40, "filter_limit": 1}, {}):
        got = ngram_join.jaccard_components(frame(spark, rows), **kw)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute.components(rows)


def test_jaccard_of_nothing(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in ngram_join.jaccard_components(spark.createDataFrame([(3, None)], SCHEMA)).collect()] == [(3, 0, 3)]


def test_signatures_lose_no_link():
    """Any two sets at the threshold share a signature, whatever the frequencies."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        a = np.unique(hashing.mix(rng.integers(1, 1 << 40, n).astype(np.uint64)))
        b = a.copy()
        for _ in range(300):
            c = b[rng.random(len(b)) > 0.02]
            c = np.unique(np.concatenate([c, hashing.mix(rng.integers(1, 1 << 40, int(rng.integers(0, 3))).astype(np.uint64))]))
            both = len(np.intersect1d(a, c))
            if not len(c) or 100 * both < 75 * (len(a) + len(c) - both):
                break
            b = c
        share = rng.random()
        frequency = {int(x): int(rng.integers(1, 5)) if rng.random() < share else 0 for x in np.union1d(a, b)}
        sigs = []
        for x in (a, b):
            rare, common = ngram_join.signatures(x, np.array([frequency[int(t)] for t in x]), 75)
            sigs.append(set(rare.tolist()) | set(common.tolist()))
        assert sigs[0] & sigs[1]


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(hashing.mix(rng.integers(0, 400, int(rng.integers(1, 300))).astype(np.uint64))) for _ in range(2))
        assert ngram_join.least_difference(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(np.setxor1d(a, b))


def test_repeats(spark, rows):
    random.seed(3)
    passages = ["".join(random.choices("abcdé ", k=random.randint(50, 400))) for _ in range(20)]
    own = [(i, "".join(random.choice(passages) if random.random() < 0.5 else "".join(random.choices("abcdé ", k=random.randint(0, 150))) for _ in range(random.randint(0, 8)))) for i in range(100)]
    own += [(None, None), (900, ""), (901, "x" * 1000), (902, "x" * 99), (903, "ab" * 300), (904, "\0" * 300), own[5], (905, own[5][1])]
    for kw in ({}, {"hot": 1}, {"window": 40, "gram": 12}):
        got = suffix_dedup.remove_repeats(frame(spark, own), **kw).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute.repeats(own, kw.get("window", 100))
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeats_keep_columns(spark):
    df = spark.createDataFrame([(1, "é" * 80, "x"), (2, "aé" + "é" * 80, "y")], "doc_id long, text string, start string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, keep_columns=True).collect()}
    assert got[1].text == "é" * 30 or got[1].text.startswith("é")
    assert got[2].start == "y" and len(got[2].text) < 80


def test_lines(spark, rows):
    for least in (2, 10, 30):
        for limit in (10**6, 0):
            got = line_dedup.drop_lines(frame(spark, rows), min_docs=least, broadcast_keys=limit)
            assert sorted((tuple(r) for r in got.collect()), key=str) == brute.lines(rows, least)
    assert line_dedup.drop_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_runs(spark, rows, tmp_path):
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", fanout=2)
    batches = [line_dedup.line_counts(frame(spark, rows[i::5])).select("h1", "h2", "docs") for i in range(5)]
    seen = set()
    for b in batches:
        own = {(r.h1, r.h2) for r in b.collect()}
        assert {(r.h1, r.h2) for r in runs.fresh(b).collect()} == own - seen
        runs.add(b)
        seen |= own
        assert all(len(level) < 2 for level in runs.levels)
    whole = {(r.h1, r.h2): r.docs for r in line_dedup.line_counts(frame(spark, rows)).collect()}
    assert {(r.h1, r.h2): r.docs for r in runs.rows().groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).collect()} == whole


@pytest.fixture(scope="module")
def rank_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, rows, rank_encoding):
    got = byte_bpe.decode(byte_bpe.encode(frame(spark, rows))).collect()
    wanted = sorted(((d, rank_encoding.encode_ordinary(t or ""), t or "") for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=str) == wanted
    digests = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(frame(spark, rows)))).collect()
    assert sorted((r.ids_sha256 for r in digests)) == sorted(hashlib.sha256(" ".join(map(str, w[1])).encode()).hexdigest() for w in wanted)
    assert sorted((r.decoded_sha256 for r in digests)) == sorted(hashlib.sha256(w[2].encode()).hexdigest() for w in wanted)


def test_byte_bpe_offsets(spark):
    text = "naïve 你好 x²"
    r = byte_bpe.encode(spark.createDataFrame([(1, text)], SCHEMA), offsets=True).first()
    assert r.char_start[0] == 0 and r.char_end[-1] == len(text) and all(a < b for a, b in zip(r.char_start, r.char_end, strict=True))
    table = byte_bpe.byte_table()
    for i, a, b in zip(r.ids, r.char_start, r.char_end, strict=True):
        assert table[i] in text[a:b].encode()


def test_encoders_on_random_text(rank_encoding):
    random.seed(11)
    letters = "ab 1²3\t\x85\xa0é×÷ªº,.!'\"\x1c¼ßȳȀÃ\nΣςİ你é st"
    texts = ["".join(random.choices(letters, k=random.randint(0, 14))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in byte_encoder()(texts)] == [rank_encoding.encode_ordinary(x) for x in texts]
    word = word_encoder()
    assert [np.frombuffer(x, "<u4").tolist() for x in word(texts)] == [word.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing(spark, rows):
    own = [*rows, *((2000 + i, " ".join(random.choices(["one", "two", "three"], k=random.randint(1, 900)))) for i in range(60))]
    got = packing.pack(frame(spark, own)).collect()
    encode = word_encoder().tokenizer.encode
    wanted = []
    for d, t in own:
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            wanted.append((d, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(wanted, key=str)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(w[3] for w in wanted) // 2048) + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sweep_places_every_rank_once():
    random.seed(1)
    for _ in range(50):
        counts = {random.randint(1, 64): random.randint(1, 40) for _ in range(random.randint(1, 20))}
        seen, filled = {}, {}
        for length, a, b, first, offset in packing.sweep(counts, 64):
            for r in range(a, b):
                seen[length, r] = seen.get((length, r), 0) + 1
                filled.setdefault(first + r - a, []).append((offset, length))
        assert set(seen.values()) == {1} and len(seen) == sum(counts.values())
        for parts in filled.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 64


def test_simhash(spark, rows):
    own = [(d, t) for d, t in rows if d is not None and (d, t) != rows[5]] + [rows[5]]
    own = list({d: (d, t) for d, t in own}.values())
    ordered = sorted(own, key=lambda r: -r[0])
    got = {r.doc_id: r for r in simhash.compare_edits(frame(spark, own), parts=3).collect()}
    assert len(got) == len(own)
    for k, (d, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        r = got[d]
        other = simhash.edited(t, following)
        assert (r.n_chars, r.edited) == (len(t), other)
        own, changed, after = (brute.simhash(x) for x in (t, other, following))
        assert (int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (own, changed)
        assert r.near_edited == 1 - (own ^ changed).bit_count() / 256 and r.near_next == 1 - (own ^ after).bit_count() / 256
    assert simhash.compare_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    one = simhash.compare_edits(spark.createDataFrame([(1, "abcd")], SCHEMA)).first()
    assert one.edited == "abab" and one.near_next == 1


def test_simhash_pairs(spark, rows):
    prints = simhash.fingerprints(frame(spark, rows))
    values = sorted({r.fingerprint for r in prints.collect()})
    for radius in (0, 5, 40):
        wanted = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (int(a, 16) ^ int(b, 16)).bit_count() <= radius}
        assert {(r.a, r.b) for r in simhash.near_pairs(prints, radius).collect()} == wanted


def test_token_counts(spark, rows, tmp_path, rank_encoding):
    wanted = sorted(((d, len(rank_encoding.encode_ordinary(t or ""))) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in token_counts.counts_of(frame(spark, rows)).collect()), key=str) == wanted
    ids = np.array([5, 50256, 50256, 7, 8, 9, 50256, *range(30), 50256, 3, 4], "<u2")
    folder = tmp_path / "flat"
    folder.mkdir()
    ids.tofile(folder / "a.bin")
    for size in (2, 6, 10, 1 << 20):
        got = sorted((r.ordinal, r.n_tokens) for r in token_counts.count(spark, f"file://{folder}", block_bytes=size, group=3).collect())
        assert got == [(0, 1), (1, 0), (2, 3), (3, 30), (4, 2)]
    np.array([1, 2, 50256], "<u2").tofile(folder / "b.bin")
    np.array([], "<u2").tofile(folder / "c.bin")
    np.array([9] * 40, "<u2").tofile(folder / "d.bin")
    got = sorted(tuple(r) for r in token_counts.count(spark, f"file://{folder}", block_bytes=4, group=2).where("file <> 'a.bin'").collect())
    assert got == [("b.bin", 0, 2), ("d.bin", 0, 40)]


def test_toxicity(spark):
    random.seed(2)
    words = "the of and river stone house green water light with many small open field".split()
    rows, labels = [], []
    for i in range(600):
        text = random.choices(words, k=random.randint(5, 60))
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                text.insert(random.randrange(len(text)), random.choice(["idiot", "stupid", "m0r0n", "grumblefrotz"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs = toxicity.documents(frame(spark, [*rows, (7000, None), (7001, "")]))
    marks = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = {r.doc_id for r in marks.where(toxicity.held_out()).collect()}
    assert held == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [got[i].predicted == (i % 5 == 0) for i in held]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[7000].score == got[7001].score and got[7001].predicted == 0
    kept = toxicity.score(docs, model, keep_columns=True)
    assert kept.count() == sum(1 for r in got.values() if not r.predicted)
    blind = toxicity.train(docs, marks.limit(0))
    assert toxicity.score(docs, blind).count() == 602


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    raw = rng.random(500)
    x, y = toxicity.isotonic(raw, (rng.random(500) < raw).astype(float))
    assert (np.diff(x) > 0).all() and len(x) < 200
