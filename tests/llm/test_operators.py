"""Operators against brute force on a small table with awkward rows, and on sf0.001."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from photonframe.llm import graph, license_scan, media_ogg, merkle, packing, quality_rules, secret_scan, sentencepiece_bpe, sharding, simhash, substring_dedup
from photonframe.llm.queries import QUERIES, tokenizer_file

from .fixtures import SCHEMA, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names operators use themselves must not clash.
    return spark.createDataFrame(rows(), SCHEMA).withColumns({"row": F.lit("r"), "fp": F.lit(1), "shard": F.lit(2), "spans": F.lit("s"), "late": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


# ---- packing
def test_packing_places_every_token_once(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = packing.pack(docs, tokenizer_file("word_bpe_49k.json"), max_len=64, open_windows=4).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    copies = Counter(r[0] for r in rows())
    for i, text, *_ in rows():
        ids = model.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids) * copies[i]
        for r in pieces:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_packing_of_nothing(none):
    assert packing.pack(none, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_open_windows_are_bounded():
    w = packing.OpenWindows(3, 10)
    out = [x for n in (6, 6, 6, 5, 4, 4, 4) for x in packing._split(w.put(n, n))]
    assert out == [[6], [6, 4], [6, 4]] and len(w.items) <= 3


# ---- SentencePiece
def test_pieces_as_the_library(docs):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {i: library.encode(t or "", add_bos=True, add_eos=True) for i, t, *_ in rows()}
    for r in sentencepiece_bpe.encode_decode(docs, path).collect():
        assert r.ids == want[r.doc_id] and r.decoded == library.decode(want[r.doc_id]) and r.n_tokens == len(r.ids)
    for r in sentencepiece_bpe.encode_decode(docs, path, digest=True).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()


def test_pieces_of_random_texts():
    import random

    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library, own, r = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.codec(path), random.Random(3)
    parts = [*"abcdeth inoé▁ \n\t0Ω日😀", "the", "ing", "  ", "▁▁", "ation"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        want = library.encode(text, add_bos=True, add_eos=True)
        raw, n, decoded = own.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == want and n == len(want) and decoded == library.decode(want) == own.decode(want)
        ids = [r.randint(3, 2000) for _ in range(r.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids)


# ---- Ogg
def test_ogg_checksum_and_round_trip(docs):
    def slow(data):
        c = 0
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
            c &= 0xFFFFFFFF
        return c

    assert media_ogg.checksum(b"OggS and more") == slow(b"OggS and more")
    got = {r.doc_id: r for r in media_ogg.store_and_read(docs, keep_media=True).collect()}
    for i, text, *_ in rows():
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)


def test_ogg_damage_and_lacing(spark):
    data = [b"z" * n for n in (0, 255, 510, 70_000, 3, 254, 256)]
    pages = media_ogg.stream_pages(7, data, list(range(1, 8)))
    found, bad = media_ogg.pages(b"junk".join(pages))
    assert bad == 0 and [p.data for p in media_ogg.packets(found)] == data
    broken = bytearray(b"".join(pages))
    broken[400] ^= 1
    found, bad = media_ogg.pages(bytes(broken))
    left = [p.data for p in media_ogg.packets(found)]
    assert bad == 1 and left == data[4:]  # the packet that began in the lost page goes too
    table = spark.createDataFrame([(1, bytearray(media_ogg.write(b"ab" * 400))), (2, None)], "id long, media binary")
    rows_ = media_ogg.demultiplex(table, "media", "id").collect()
    assert {r.serial for r in rows_} == {1, 2} and len(rows_) == 5 and all(r.end_s is not None for r in rows_)


# ---- sharding
def test_shards_have_exact_sizes(spark, docs, none):
    placed = sharding.shuffle_into_shards(sharding.digest_rows(docs), shards=4).collect()
    sizes = Counter(r.shard for r in placed)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == len(rows())
    for s in sizes:
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sizes[s]))
    text = dict((r[0], r[1] or "") for r in rows())
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in placed)
    assert sharding.shuffle_into_shards(sharding.digest_rows(none)).count() == 0
    many = sharding.shuffle_into_shards(spark.range(1000).repartition(7), shards=3, block_rows=50)
    assert many.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).where("n = d and m = n - 1").count() == 3


def test_matrix_rows_add_up():
    counts, sizes = [5, 0, 17, 8, 1], np.array([10, 10, 11])
    starts = np.cumsum([0, *counts])
    matrix = np.array([sharding.matrix_row(starts, sizes, p, 3) for p in range(5)])
    assert matrix.sum(1).tolist() == counts and matrix.sum(0).tolist() == sizes.tolist()


def test_matrix_beyond_numpys_limit():
    counts, sizes = [10**9, 3, 2 * 10**9, 5 * 10**8], sharding.shard_sizes(35 * 10**8 + 3, 7)
    starts = np.cumsum([0, *counts])
    matrix = np.array([sharding.matrix_row(starts, sizes, u, 3) for u in range(4)])
    assert matrix.sum(1).tolist() == counts and matrix.sum(0).tolist() == sizes.tolist()
    share = matrix[2] / counts[2] - sizes / sizes.sum()
    assert np.abs(share).max() < 6 * (1 / 7 / counts[2]) ** 0.5 and np.abs(share).max() > 0


def test_rejection_follows_the_law():
    from math import comb

    rng = np.random.default_rng(1)
    for good, bad, n in ((30, 50, 20), (7, 4, 8), (500, 300, 400)):
        got = Counter(sharding.rejection(rng, good, bad, n) for _ in range(20_000))
        law = {x: comb(good, x) * comb(bad, n - x) / comb(good + bad, n) for x in range(max(0, n - bad), min(good, n) + 1)}
        cells = [(got[x], 20_000 * p) for x, p in law.items() if 20_000 * p >= 10]
        assert sum((a - b) ** 2 / b for a, b in cells) < len(cells) + 5 * (2 * len(cells)) ** 0.5


def test_matrix_is_uniform():
    # Two units and three shards of six rows: each matrix as often as the law says.
    from math import comb

    starts, sizes = np.array([0, 3, 6]), np.array([2, 2, 2])
    got = Counter(tuple(sharding.matrix_row(starts, sizes, 0, s).tolist()) for s in range(6000))
    law = {(a, b, 3 - a - b): comb(2, a) * comb(2, b) * comb(2, 3 - a - b) / 20 for a in range(3) for b in range(3) if 0 <= 3 - a - b <= 2}
    assert set(got) == set(law) and sum((got[m] - 6000 * p) ** 2 / (6000 * p) for m, p in law.items()) < 30


def test_shards_when_files_are_split_anew(spark):
    placed = sharding.shuffle_into_shards(spark.range(3000).repartition(5), shards=7)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "2000")
    try:
        got = placed.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r.id for r in got) == list(range(3000))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and {(r.shard, r.slot) for r in got} == {(s, k) for s in sizes for k in range(sizes[s])}


# ---- quality
def brute_base(text):
    text = text or ""
    w = words(text)
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(docs, none):
    got = quality_rules.quality(docs).collect()
    assert len(got) == len(rows())
    want = {i: brute_base(t) for i, t, *_ in rows()}
    for r in got:
        w = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == w
        assert r.base_failed == (w[0] < 10 or 100 * w[4] > 20 * w[0]) and not (r.base_failed and r.kept)
    assert quality_rules.quality(none).count() == 0
    assert quality_rules.keep(docs).columns == docs.columns


KN_TEXTS = [("en", "abracadabra abracadabra " * 3), ("en", "a cab, a bar, a cab, a barn and a bra"), ("xx", "zzz abz zaz"), ("en", None), ("xx", "")]


def brute_kneser_ney(texts, order, share):
    """Probability of a byte after a context, from the definitions."""
    raw = Counter()
    for lang, t in texts:
        b = b"\n" * (order - 1) + (t or "").encode()
        raw.update((lang, b[i : i + order]) for i in range(len(b) - order + 1))
    counts, often = {order: raw}, {order: raw}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter((lang, g[1:]) for lang, g in counts[k + 1])
        often[k] = Counter()
        for (lang, g), n in often[k + 1].items():
            often[k][lang, g[1:]] += n
    languages = {lang for lang, _ in raw}
    total = {lang: sum(n for (own, _), n in raw.items() if own == lang) for lang in languages}
    cuts = {}
    for k, lang in ((k, lang) for k in counts for lang in languages):
        n1, n2, n3, n4 = (sum(v == i for (own, _), v in counts[k].items() if own == lang) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        cuts[k, lang] = [min(max(v, 0), i) for i, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))] if n1 and n2 and n3 else [0.5, 1.0, 1.5]

    def p(lang, g):
        k = len(g)
        if k == 0:
            return 1 / 256
        inside = {h: n for (l, h), n in counts[k].items() if l == lang and h[:-1] == g[:-1]}
        if not inside:
            return p(lang, g[1:])
        share_of = {h: max(n - cuts[k, lang][min(n, 3) - 1], 0) / sum(inside.values()) for h, n in inside.items() if often[k][lang, h] * (share // len(languages)) >= total[lang]}
        return share_of.get(g, 0) + (1 - sum(share_of.values())) * p(lang, g[1:])

    return raw, p


@pytest.mark.parametrize("order,share", [(3, 10**6), (3, 40), (2, 30)])
def test_kneser_ney_as_defined(spark, order, share):
    model = quality_rules.fit(spark.createDataFrame(KN_TEXTS, "lang string, text string"), order, share)
    grams, p = brute_kneser_ney(KN_TEXTS, order, share)
    code = lambda g: int.from_bytes(g, "big")
    for lang, g in [*grams, ("en", b"q" * order), ("xx", b"aq\n"[-order:]), ("xx", b"abr"[:order])]:
        assert abs(model.log_probability(lang, np.array([code(g)]))[0] / quality_rules.SCALE - np.log(p(lang, g))) < 5e-4 * order
    for lang, g in grams:
        every = np.array([code(g[:-1] + bytes([x])) for x in range(256)])
        assert abs(np.exp(model.log_probability(lang, every) / quality_rules.SCALE).sum() - 1) < 0.01
    assert all(len(level[0]) <= share and (np.diff(level[0]) > 0).all() for own in model.levels.values() for level in own.values())


def test_a_rare_language_keeps_its_model(spark):
    """Its arrays are the same beside 20 texts of another language and beside 2,000 times its bytes."""
    rare = [("xx", prose(900 + i, 30)) for i in range(8)]
    few, many = [("en", prose(i, 60)) for i in range(20)], [("en", prose(i, 2_000)) for i in range(250)]
    models = [quality_rules.fit(spark.createDataFrame(rare + other, "lang string, text string"), share=1 << 13) for other in (few, many)]
    first, second = (m.levels["xx"] for m in models)
    assert first.keys() == second.keys() == set(range(1, 7))
    assert all((x == y).all() for k in first for x, y in zip(first[k], second[k], strict=True)) and len(first[6][0]) > 100
    assert all(len(level[0]) <= 1 << 12 for m in models for own in m.levels.values() for level in own.values())


def test_scores_and_verdicts_by_brute_force(docs, spark):
    spark_rows = {(r.doc_id, r.lang): r for r in quality_rules.quality(docs).collect()}
    texts = [(r[2] or "null", r[1]) for r in rows()]
    model = quality_rules.fit(spark.createDataFrame(texts, "lang string, text string"))
    for i, text, lang, *_ in rows():
        raw = (text or "").encode()
        padded = b"\n" * (quality_rules.ORDER - 1) + raw
        codes = np.array([int.from_bytes(padded[k : k + quality_rules.ORDER], "big") for k in range(len(raw))], np.int64)
        total = int(model.log_probability(lang or "null", codes).sum())
        assert spark_rows[i, lang].log_ppl == -total * quality_rules.STEP // (quality_rules.SCALE * max(len(words(text)), 1))
    for lang in {r[2] for r in rows()}:
        own = [r for r in spark_rows.values() if r.lang == lang]
        passed = [r for r in own for _ in range(2 if r.doc_id == 0 else 1) if not r.base_failed]
        middle = np.percentile([r.log_ppl for r in passed], 50)
        off = lambda r: np.sign(v := (r.log_ppl - middle) / np.sqrt(1 + quality_rules.SHORT / max(r.n_words, 1))) * np.floor(abs(v) + 0.5)  # noqa: B023, E731
        low, high = np.percentile([off(r) for r in passed], [25, 75])
        for r in own:
            assert r.kept == (not r.base_failed and low - 6 * (high - low) <= off(r) <= high + 4 * (high - low))


def test_rare_n_grams_count_in_full(spark):
    """A language's scores are by definition, also beside 1,000 others and when few n-grams are broadcast or none."""
    own = [(i, prose(700 + i, 150), "en") for i in range(12)] + [(12, "", "en"), (13, None, "en"), (14, prose(700, 20) + "\n" + prose(700, 20), "en")]
    other = [(100 + i, f"{i} ab", f"l{i}") for i in range(1_000)]
    score = lambda table, **more: {r.doc_id: r.log_ppl for r in quality_rules.quality(spark.createDataFrame(table, "doc_id long, text string, lang string"), **more).collect() if r.lang == "en"}
    got = score(own + other)
    assert score(own, hot=700) == score(own + other, hot=0) == got
    _, p = brute_kneser_ney([(lang, t) for _, t, lang in own], quality_rules.ORDER, 10**9)
    text = own[-1][1]
    raw = b"\n" * (quality_rules.ORDER - 1) + text.encode()
    total = sum(round(np.log(p("en", raw[k : k + quality_rules.ORDER])) * quality_rules.SCALE) for k in range(len(text.encode())))
    assert abs(got[14] - -total * quality_rules.STEP // (quality_rules.SCALE * len(words(text)))) <= 1


def test_rare_n_grams_are_joined_in_proportion(spark, monkeypatch):
    """What is left to the join grows no faster than the table, also where ``HOT`` lies between the sizes."""
    monkeypatch.setattr(quality_rules, "SHARE", 1 << 12)
    rows, held = {}, {}
    for times in (1, 5):
        docs = spark.createDataFrame([(i, prose(800 + i, 100), "en") for i in range(20 * times)], "doc_id long, text string, lang string")
        grams = quality_rules.log_probabilities(docs.select(quality_rules._lang(F.col("lang")).alias("lang"), "text"))
        hot = grams.count() if times == 1 else hot
        common = quality_rules.commonest(grams, hot)
        held[times] = sum(len(keys) for keys, _ in common.values())
        want = {(r.lang, r.gram): r.logp for r in grams.collect()}
        assert all((np.diff(keys) > 0).all() and [want[lang, k] for k in keys.tolist()] == logp.tolist() for lang, (keys, logp) in common.items())
        rows[times] = quality_rules.score(docs, common, quality_rules.ORDER, "doc_id", "text", "lang").where("gram is not null").count()
    assert 0 < rows[5] <= 6 * rows[1]
    assert 0 < held[5] <= 1 << 12


def test_quality_rejects_odd_text(spark):
    good = [(i, prose(5000 + i, 400), "en") for i in range(250)]  # so many that a text does not teach the model itself
    odd = [(1000, " ".join(f"{w}#%{w[::-1]}@!" for w in good[0][1].split()), "en"), (1001, " ".join(w[::-1] for w in good[1][1].split()), "en")]
    got = {r.doc_id: r.kept for r in quality_rules.quality(spark.createDataFrame(good + odd, "doc_id long, text string, lang string")).collect()}
    assert not any(got[i] for i in (1000, 1001)) and sum(got.values()) >= 0.99 * len(good)


# ---- SimHash
def brute_print(text, width=3):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def test_simhash_components(docs, none):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_print(t) for i, t, *_ in rows()}
    least = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    least[a] = min(least[a], least[b])
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", least[i]) for i in prints}
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one_of_similar_texts(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(20) if i not in (1, 2, 4, 5)]
    assert simhash.keep_one(none).count() == 0


def test_similar_finds_near_copies(spark):
    import random

    r = random.Random(1)
    base = [[f"w{r.randrange(3000)}" for _ in range(300)] for _ in range(40)]
    near = [[w if k not in (50, 150, 250) else "changed" for k, w in enumerate(b)] for b in base]
    rows_ = [(i, " ".join(w)) for i, w in enumerate(base + near)]
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(40)) and sum(got[40 + i] == i for i in range(40)) >= 38


def test_similar_takes_pairs_from_the_threshold_on(spark):
    import random

    r = random.Random(3)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base = [own(304) for _ in range(80)]  # 300 shingles: 33 others give 267 / 333, 34 give 266 / 334
    near = [b[: -33 - i % 2] + own(33 + i % 2) for i, b in enumerate(base)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(base + near)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar(table).collect()}
    assert all(got[80 + i] == (80 + i if i % 2 else i) for i in range(80))


def brute_components(table, similarity=0.8, width=5):
    sets = {i: {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} for i, t in table.items() for w in [words(t)]}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
    least = {i: i for i in sets}
    while True:
        before = dict(least)
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


def test_similar_in_a_source_with_boilerplate(spark):
    import random

    r = random.Random(2)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared = own(90)
    texts = [shared + own(60) for _ in range(200)]  # strangers with a mutual similarity of 0.4
    texts += [t[:k] + own(len(t) - k) for t, k in zip(texts[:60], [136, 135, 134, 133, 145, 140] * 10, strict=True)]  # on both sides of 0.8
    texts += [own(1) + t[1:] for t in texts[200:230]]  # linked to a text that its group's least may not be
    table = dict(enumerate(" ".join(t) for t in texts))
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_components(table) and len(set(got.values())) < 200 + 60


def test_links_keep_every_connection(spark):
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = [centres] + [centres ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (k, 6)).astype(np.uint64), axis=0) for k in (1, 2, 3, 4, 5, 6) for _ in range(12)]
    fps = np.unique(np.concatenate(flips))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r_.node: r_.component for r_ in graph.components(simhash.links(nodes)).collect()}
    part = {int(x): int(x) for x in fps.view(np.int64)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for _ in range(20):
        for i, x in enumerate(fps.view(np.int64)):
            part[int(x)] = min(part[int(fps.view(np.int64)[j])] for j in np.flatnonzero(near[i]))
    assert {x: got.get(x, x) for x in part} == part


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


# ---- substring dedup
def brute_dedup(table):
    first = {}
    for i, text in sorted((i, t) for i, t in table.items()):
        w = words(text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, text in table.items():
        w = words(text)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches,fanout,salt_rows", [(1, 4, 10_000), (4, 2, 1)])
def test_substring_dedup(docs, batches, fanout, salt_rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs, batches=batches, fanout=fanout, salt_rows=salt_rows).collect()}
    want = brute_dedup({i: t or "" for i, t, *_ in rows()})
    assert got == want and any(x[1] for x in want.values())


def test_substring_strip_keeps_the_rest(docs, none):
    out = substring_dedup.strip(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    original = {i: t for i, t, *_ in rows()}
    assert texts[0] == original[0] and texts[3] is None and texts[5] == original[5] and texts[1] == ""
    assert texts[10] == original[10].split("\n")[0] + "\n"
    assert substring_dedup.dedup(none).count() == 0


# ---- secrets
def test_secret_base_spans(docs, none):
    base = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    for i, text, *_ in rows():
        spans = sorted((m.start(), k, m.end(), name) for k, (name, p, g, n) in enumerate(base) for m in re.finditer(p, text or "", re.ASCII) if len(m.group(g)) >= n)
        joined = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert "key:" in got[13].spans and "identifier:" in got[13].spans and "endpoint:" in got[13].spans
    assert got[14].spans == ""  # a weak candidate alone
    assert secret_scan.scan(none).count() == 0


def test_long_parts_are_linked_by_distance(spark):
    long = "aB3" * 300
    texts = {
        1: f"token={long} client_id=bob7",  # the part is long
        2: f"client_id=bob7 https://h/{long} token=abcdefgh",  # an endpoint between its parts is long
        3: f"https://h/{long}?client_id=bob7&{long}&token=abcdefgh&{long}",  # parts inside a long endpoint
        4: f"token=abcdefgh {'.' * 260} client_id=bob7",  # too far
        5: f"token=abcdefgh{'.' * 240} {'x ' * 4}client_id=bob7",
    }
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: {x.split(":")[0] for x in r.spans.split(",") if x} for r in secret_scan.scan(table).collect()}
    assert got == {1: {"assign", "identifier"}, 2: {"assign", "endpoint"}, 3: {"assign", "endpoint"}, 4: {"assign"}, 5: {"assign", "identifier"}}
    assert "bob7" not in secret_scan.redact(table.where("doc_id = 1")).first().text


def brute_spans(text, reach=256):
    """All spans from the stated rules, every candidate against every part."""
    flags = re.ASCII
    parts = [(m.start(), order, m.end(), kind, cls, weak) for order, (kind, cls, weak, pattern, group, least) in enumerate(secret_scan.KINDS) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]

    def near(p, cls):
        return any(q[4] == cls and q[0] - p[2] <= reach and p[0] - q[2] <= reach for q in parts if q is not p)

    needs = {"secret": ["identifier"], "identifier": ["secret"], "endpoint": ["identifier", "secret"]}
    return ",".join(f"{p[3]}:{p[0]}:{p[2]}" for p in sorted(parts, key=lambda p: p[:3]) if not p[5] or all(near(p, c) for c in needs[p[4]]))


def test_linked_spans_by_brute_force(spark):
    import random

    r = random.Random(11)
    key = lambda: "".join(r.choice("abcXYZ0189+/") for _ in range(37)) + "aB3"
    makers = [
        lambda: f"token={key()[: r.randint(4, 30)]}",
        lambda: "AKIA" + "".join(r.choice("ABCZ019") for _ in range(r.randint(12, 20))),
        lambda: "".join(r.choice("0123abcdef") for _ in range(r.randint(20, 30))),
        lambda: f"{r.choice(['user', 'client_id', 'Login'])}{r.choice([': ', '='])}{r.choice(['bob7', 'x', 'ann@x.org'])}",
        key,
        lambda: f"https://h{'/' + 'p' * r.randint(1, 600) if r.random() < 0.4 else ''}",
        lambda: "." * r.choice([1, 40, 200, 250, 300, 520]),
        lambda: "ünï日😀" * r.randint(1, 30),
    ]
    texts = [r.choice([" ", "\n"]).join(r.choice(makers)() for _ in range(r.randint(1, 14))) for _ in range(400)]
    got = {x.doc_id: x.spans for x in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}
    assert sum("key:" in x for x in got.values()) > 50 and sum("endpoint:" in x for x in got.values()) > 50


def test_secrets_of_a_very_long_text(spark):
    text = "word " * 200_000 + "user=bob7 " + "key " + "aB3" * 13 + "z " + "tail " * 200_000
    got = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.spans == brute_spans(text) and got.spans.count(":") == 4


def test_redaction(docs):
    out = secret_scan.redact(docs)
    texts = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and texts[3].text is None and texts[0].text == rows()[0][1]
    assert texts[12].text.endswith("[assign] end") and texts[12].n_chars == len(texts[12].text)
    assert "hunter2" not in texts[11].text and "AKIA" not in texts[11].text


# ---- licences
def test_licences(spark):
    files = [
        (1, "LICENSE text\nThis work is licensed under the GNU General Public License, version 3.", "a/LICENSE"),
        (2, "code", "a/b/c/x.py"),
        (3, "// Licensed under the Apache License, Version 2.0.\ndef code(x): return x + 1", "a/b/y.py"),
        (4, "Released under the MIT License.", "a/b/c/d/COPYING"),
        (5, "code", "a/b/c/d/e/z.py"),
        (6, None, None),
        (7, "my licence of driving was lost", "z/q"),
        (5, "code", "a/b/c/d/e/z.py"),
    ]
    got = {r.doc_id: (r.licence, r.origin, r.licence_dir) for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, text string, path string"), F.col("path")).collect()}
    assert got == {1: ("GPL-3.0", "file", None), 2: ("GPL-3.0", "inherited", "a"), 3: ("Apache-2.0", "header", None), 4: ("MIT", "file", None), 5: ("MIT", "inherited", "a/b/c/d"), 6: (None, "none", None), 7: (None, "none", None)}


def test_real_notices(spark):
    bsd = license_scan._BSD.format("3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")
    text = {name: t for name, t in license_scan.TEMPLATES if name in ("ISC", "MIT", "Unlicense")}
    mit = max((t for n, t in license_scan.TEMPLATES if n == "MIT"), key=len)
    files = [
        (1, "BSD 3-Clause License\n\nCopyright (c) 2021, The Somebody Project Authors\n\n" + bsd.replace("are met: ", "are met:\n\n").replace(" 2. ", "\n\n2. ").replace("this software is", "\n\nTHIS SOFTWARE IS"), "a/LICENSE"),
        (2, "/*\n * Copyright (c) 2019 Jo Doe <jo@example.org>\n *\n * " + text["ISC"].replace(". ", ".\n * ") + "\n */\nint main() { return 0; }", "b/isc.c"),
        (3, '# Copyright 2020 Acme GmbH, Inc.\n#\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\nimport os', "c/x.py"),
        (4, "// SPDX-License-Identifier: MIT\nfn main() {}", "d/x.rs"),
        (5, "MIT License\n\nCopyright (c) 2018 Somebody Else\n\n" + mit, "e/LICENSE.txt"),
        (6, "Copyright 2021 Acme GmbH, licensed under the Apache License, Version 2.0", "f/notes"),
        (7, "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "The licences for most software are designed to take away your freedom. " * 40, "g/COPYING"),
        (8, "SPDX-License-Identifier: Apache-2.0", "h/x"),
        (9, "no driving licence, no copyright lawyer, " + "only words " * 50, "i/x"),
    ]
    want = {1: "BSD-3-Clause", 2: "ISC", 3: "Apache-2.0", 4: "MIT", 5: "MIT", 6: "Apache-2.0", 7: "GPL-3.0", 8: "Apache-2.0", 9: None}
    for more in (0, 400):  # the cosine of a notice must not fall as licence texts gather
        table = spark.createDataFrame(files + [(100 + i, f"word{i} is licensed under terms{i % 9} of some licence{i}", f"z{i}/x") for i in range(more)], "doc_id long, text string, path string")
        table = table.withColumns({"row": F.lit("x"), "dir": F.lit(1), "lines": F.lit("y"), "term": F.lit("t")})
        got = {r.doc_id: r.licence for r in license_scan.scan(table, F.col("path")).where("doc_id < 100").collect()}
        assert got == want, (more, got)
    assert license_scan.scan(table.where("false"), F.col("path")).count() == 0


def test_licences_of_long_texts_and_ties(spark):
    long = "x " * 500_000 + "\nReleased under the MIT License.\n" + "y " * 500_000
    files = [(1, long, "a/x"), (2, "Released under the MIT License.", "a/LICENSE"), (3, "Released under the MIT License.", "a/COPYING"), (4, "Licensed under CC BY-NC 4.0", "a/LICENSE"), (5, "", "a/b/y")]
    got = {r.doc_id: (r.licence, r.origin) for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, text string, path string"), F.col("path")).collect()}
    assert got[1] == ("MIT", "header") and got[2] == got[3] == ("MIT", "file") and got[5] == ("CC-BY-NC-4.0", "inherited")


# ---- Merkle
def merkle_records(spark, rows_):
    table = spark.createDataFrame(rows_, "a long, k long, p string").withColumns({"idx": F.lit("x"), "name": F.lit(0), "offset": F.lit(None).cast("string")})
    return merkle.records(table, F.col("a"), F.col("k"), F.col("p"))


def test_merkle_finds_the_damage(spark):
    own = [(i // 40, i, None if i == 7 else f"payload {i}") for i in range(100)]
    # The other replica is made of its own rows: one lost, one longer, one added, one empty.
    other = [(a, k, p + " and more" if k == 13 else "" if k == 7 else p) for a, k, p in own if k != 45] + [(2, 1000, "new")]
    got = {r.archive: r for r in merkle.report(merkle_records(spark, own), merkle_records(spark, other), fanout=3).collect()}
    parts = {a: [x.split(":")[:2] for x in r.faults.split(",")] for a, r in got.items()}
    assert parts == {0: [["7", "corrupt"], ["13", "corrupt"]], 1: [["5", "missing"]], 2: [["20", "extra"]]}
    assert not any(r.intact for r in got.values()) and [got[a].n_faults for a in range(3)] == [2, 1, 1]


def test_merkle_of_awkward_replicas(spark):
    long = "x" * 3_000_000
    own = [(None, 1, "a"), (None, None, "b"), (None, None, "c"), (1, 5, long), (1, 5, long), (2, 1, "z")]
    same = {r.archive: r for r in merkle.report(merkle_records(spark, own), merkle_records(spark, own[::-1])).collect()}
    assert set(same) == {None, 1, 2} and all(r.intact and r.n_faults == 0 and r.root_a == r.root_b for r in same.values())
    less = {r.archive: r for r in merkle.report(merkle_records(spark, own), merkle_records(spark, own[1:4])).collect()}
    assert {a: (r.intact, r.n_faults) for a, r in less.items()} == {None: (False, 1), 1: (False, 1), 2: (False, 1)} and less[2].root_b is None
    empty = merkle_records(spark, [])
    assert merkle.report(empty, empty).count() == 0 and merkle.report(empty, merkle_records(spark, own)).count() == 3


def test_merkle_reports_one_lost_record_as_one(spark):
    own = [(0, i, f"p{i}") for i in range(600)]
    for lost in (0, 17, 599):
        r = merkle.report(merkle_records(spark, own), merkle_records(spark, [x for x in own if x[1] != lost])).first()
        assert (r.n_faults, r.faults.split(":")[:2]) == (1, [str(lost), "missing"])


# ---- queries
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    out = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert out.count() >= (1 if table == "pages" else n)


def test_empty_tables_and_long_texts(spark, none):
    assert sentencepiece_bpe.encode_decode(none, tokenizer_file("piece_bpe_32k.model")).count() == 0
    assert media_ogg.store_and_read(none).count() == 0
    long = "word 日本 " * 300_000
    placed = sharding.shuffle_into_shards(sharding.digest_rows(spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")), shards=3).collect()
    assert {r.doc_id: r.size for r in placed} == {1: len(long.encode()) + 16, 2: 16} and sorted(r.slot for r in placed) == [0, 0]


# ---- null ids
def test_rows_without_id(spark):
    text = rows()[0][1]
    table = spark.createDataFrame([(None, text, None, None, None), (None, None, None, None, None), (4, text, "en", "s", 1)], SCHEMA)
    n = lambda df: df.count()
    assert n(sentencepiece_bpe.encode_decode(table, tokenizer_file("piece_bpe_32k.model"), digest=True)) == 3
    assert n(media_ogg.store_and_read(table)) == 3 and n(secret_scan.scan(table)) == 3 and n(quality_rules.quality(table)) == 3
    assert n(sharding.shuffle_into_shards(sharding.digest_rows(table), shards=2)) == 3
    assert packing.pack(table, tokenizer_file("word_bpe_49k.json")).count() == 3
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(table).collect()]
    assert sorted(got, key=str) == sorted([(None, 4), (None, None), (4, 4)], key=str)
    assert sorted(((r.doc_id, r.n_removed) for r in substring_dedup.dedup(table).collect()), key=str) == sorted([(None, 0), (None, 0), (4, 0)], key=str)
    assert simhash.keep_one(table).count() == 2
    out = license_scan.scan(table, F.col("source"))
    assert out.count() == 3 and out.where("origin = 'none'").count() == 3


def test_very_long_texts(spark):
    long_word, many = "x" * 200_000, "ab cd " * 40_000
    table = spark.createDataFrame([(1, long_word, "en", "s", 0), (2, many, "en", "s", 0)], SCHEMA)
    assert packing.pack(table, tokenizer_file("word_bpe_49k.json")).agg(F.sum("length")).first()[0] > 80_000
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.quality(table).collect()} == {1: 0, 2: 80_000}
    assert {r.doc_id: r.payload_bytes for r in media_ogg.store_and_read(table).collect()} == {1: 200_064, 2: 240_000}
    assert simhash.near_duplicates(table).count() == 2 and substring_dedup.dedup(table).where("n_removed = 0").count() == 2
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    for r in sentencepiece_bpe.encode_decode(table, tokenizer_file("piece_bpe_32k.model")).collect():
        assert r.ids == library.encode(long_word if r.doc_id == 1 else many, add_bos=True, add_eos=True)


# ---- the pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        now = docs.count()
        if name != "packing":
            assert docs.columns == columns and now <= before and docs.select("doc_id").distinct().count() == now
            assert docs.where("n_chars <> length(text)").count() == 0
            before = now
    assert docs.select("doc_id").distinct().count() == before


def test_class_counts_never_rule_out_too_much():
    """Counts by class differ by no more than the sets do, whatever their sizes."""
    r = np.random.default_rng(11)
    for n in (1, 5, 60, 900, 20_000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.8], r.integers(0, 1 << 63, max(1, n // 6), dtype=np.uint64)]))
        apart = int(np.abs(simhash.class_counts(a).astype(int) - simhash.class_counts(b)).sum())
        assert apart <= len(np.setxor1d(a, b)) and (simhash.class_counts(a) == simhash.class_counts(a.copy())).all()
    assert simhash.class_counts(np.zeros(0, np.uint64)).sum() == 0
