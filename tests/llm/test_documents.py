import random
import zlib

import numpy as np
import pytest

from textloom.llm import near_duplicates as nd, suffix_repeats as sr
from textloom.llm.decontamination import op4_decontamination
from textloom.llm.graph import components
from textloom.llm.language_id import op3_language_id
from textloom.llm.media import FORMATS, op7_media_sniffing, padded, payload_of, sniff_bytes, to_bmp, to_png, to_wav
from textloom.llm.near_duplicates import op5_near_duplicates
from textloom.llm.piece_encoding import MODEL, Encoder, Normaliser, encode, op10_piece_encoding
from textloom.llm.suffix_repeats import op9_suffix_repeats
from textloom.llm.token_counts import Cutter, count_tokens, op6_token_counts

from . import brute

VOCABULARY = ["alpha", "Beta", "gamma", "délta", "the", "of", "and", "x", "ümlaut", "zeta", "eta", "iota"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + str(r.randrange(30)) for _ in range(n))


def edited(text, seed, k):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = f"new{r.randrange(99)}"
    return " ".join(w)


ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "one"), (905, "ONE two"), (906, "..."), (907, "\x00a\x1c\u2028b 日本語 🎉"), (908, "a" * 400), (909, "a" * 400 + "b")]


@pytest.fixture(scope="module")
def corpus():
    base = [(i, prose(i, 120)) for i in range(12)]
    copies = [(20 + i, base[i % 4][1]) for i in range(6)] + [(40 + i, edited(base[i % 5][1], i, 1 + i % 4)) for i in range(25)]
    passage = prose(77, 60)
    mixed = [(80 + i, prose(100 + i, 30) + " " + passage[i * 7 :] + " " + prose(200 + i, 20)) for i in range(8)]
    return base + copies + mixed + ODD


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def near_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_near_duplicates(spark, docs, corpus):
    assert near_rows(op5_near_duplicates(spark, docs(corpus, extra=True))) == brute.near(corpus)


def test_near_duplicates_at_eighty(spark, docs, corpus):
    docs(corpus)
    assert near_rows(nd.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string"), 80)) == brute.near(corpus, 80)


@pytest.mark.parametrize("unit", [1, 3, 8])
def test_near_duplicates_of_large_groups(spark, docs, corpus, monkeypatch, unit):
    monkeypatch.setattr(nd, "UNIT", unit)
    monkeypatch.setattr(nd, "BLOCK", unit)
    monkeypatch.setattr(nd, "PER_SET", 0 if unit < 8 else 40)
    monkeypatch.setattr(nd, "BROADCAST_ROWS", -1)
    one = prose(31, 150)
    chain = [one]
    for k in range(30):  # neighbours are alike, the ends are not
        chain.append(edited(chain[-1], 1000 + k, 2))
    rows = corpus + [(2000 + (i * 7) % 31, t) for i, t in enumerate(chain)]
    assert near_rows(op5_near_duplicates(spark, docs(rows))) == brute.near(rows)


def test_near_duplicates_of_long_texts_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(nd, "UNIT_SHINGLES", 5_000)
    long = prose(41, 40_000)
    rows = [(3, long), (2, edited(long, 1, 400)), (1, edited(long, 2, 400)), (4, prose(42, 40_000)), (9, long)]
    assert near_rows(op5_near_duplicates(spark, docs(rows))) == brute.near(rows)


def test_near_duplicates_of_repeated_rows(spark, docs):
    w = prose(51, 100)
    v = edited(w, 3, 2)
    rows = [(1, w), (2, v), (2, v), (3, prose(52, 100)), (3, prose(53, 50)), (4, prose(53, 50)), (5, "x"), (5, None), (6, "x"), (None, w), (None, w), (None, None), (7, w), (7, prose(52, 100))]
    got_rows = near_rows(op5_near_duplicates(spark, docs(rows)))
    assert got_rows == brute.near(rows) and len(got_rows) == len(rows)


def test_words_that_polynomials_confuse_are_different(spark, docs):
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    rows = [(1, t[:1024]), (2, t[1024:2048]), (3, t), (4, t.translate({97: 98, 98: 97})), (5, t[:64]), (6, t[64:128])]
    assert near_rows(op5_near_duplicates(spark, docs(rows))) == brute.near(rows)


def test_keys_hold_the_pigeonhole():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 16, (200, nd.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[r.choice(nd.SYMBOLS, 15, replace=False)] ^= 1
    assert all(set(x) & set(y) for x, y in zip(nd.chunk_keys(a), nd.chunk_keys(b)))


@pytest.mark.parametrize("one_task", [0, 20, 15_000])
def test_components(spark, monkeypatch, one_task):
    from textloom.llm import graph

    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    out = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_suffix_repeats(spark, docs, corpus):
    out = got(op9_suffix_repeats(spark, docs(corpus, extra=True)))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in out.items()} == {d: (a, b, c, brute.sha(k)) for d, (a, b, c, k) in brute.without_repeats(corpus).items()}


@pytest.mark.parametrize("setting", [("HOT", 0), ("TASK_CONTEXTS", 1), ("PIECE", 300), ("BROADCAST_ROWS", -1), ("FLUSH", 10)])
def test_suffix_repeats_by_other_ways(spark, docs, corpus, monkeypatch, setting):
    monkeypatch.setattr(sr, *setting)
    out = got(op9_suffix_repeats(spark, docs(corpus)))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans) for d, r in out.items()} == {d: v[:3] for d, v in brute.without_repeats(corpus).items()}


def test_suffix_repeats_in_long_texts(spark, docs):
    block = prose(5, 400)
    texts = [(1, prose(1, 60_000) + block + prose(2, 20_000)), (2, prose(3, 100) + block), (3, block * 3)]
    out = got(op9_suffix_repeats(spark, docs(texts)))
    assert {d: (r.n_removed, r.n_spans) for d, r in out.items()} == {d: v[1:3] for d, v in brute.without_repeats(texts).items()}


def test_suffix_repeats_of_anchors_hot_in_one_worker(spark, monkeypatch):
    monkeypatch.setattr(sr, "HOT", 1)
    monkeypatch.setattr(sr, "FLUSH", 0)
    passage = prose(6, 18)
    rows = []
    for k in range(8):  # in one part of the table a passage with four contexts, in another with one
        passage = prose(600 + k, 18)
        rows += [(k, " ".join(prose(20 * k + i, 20) + f" {i}" + passage + f"{i} " for i in range(4))), (100 + k, prose(900 + k, 20) + " <" + passage + "> ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(2, "doc_id")
    coalesce, partitions = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    spark.conf.set(coalesce, "false")
    spark.conf.set(partitions, "16")
    try:
        out = got(sr.without_repeats(df))
    finally:
        spark.conf.unset(coalesce)
        spark.conf.set(partitions, "4")
    assert {d: (r.n_bytes, r.n_removed, r.n_spans) for d, r in out.items()} == {d: v[:3] for d, v in brute.without_repeats(rows).items()}


def test_intervals_are_those_of_a_plain_scan():
    r = np.random.default_rng(4)
    for _ in range(50):
        lcp = r.integers(0, 4, 12)
        lcp[0] = 0
        want = set()
        for i in range(12):
            for j in range(i + 1, 12):
                d = lcp[i + 1 : j + 1].min()
                left, right = lcp[i], lcp[j + 1] if j < 11 else 0
                if d > max(left, right):
                    want.add((i, j, d, max(left, right)))
        assert set(map(tuple, sr.intervals(lcp, 1).tolist())) == want


def test_decontamination(spark, docs, folder, corpus):
    items = [(1, prose(77, 60)), (2, corpus[3][1][40:300]), (3, "alpha3 of4"), (4, "ONE"), (5, None), (6, ""), (7, prose(77, 60)), (8, "..."), (10, prose(999, 40))]
    folder(True, benchmark=items)
    out = got(op4_decontamination(spark, docs(corpus, extra=True)))
    assert {d: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for d, r in out.items()} == brute.decontaminated(corpus, items)


def test_decontamination_without_broadcasts(spark, docs, folder, corpus, monkeypatch):
    from textloom.llm import decontamination

    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    items = [(1, prose(77, 60)), (2, corpus[3][1][40:300]), (3, "alpha3 of4"), (4, corpus[3][1][40:300])]
    folder(benchmark=items)
    out = got(op4_decontamination(spark, docs(corpus)))
    assert {d: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for d, r in out.items()} == brute.decontaminated(corpus, items)


def test_decontamination_of_each_row_by_its_own_text(spark, docs, folder):
    item, long = prose(77, 40), prose(5, 30_000)
    folder(benchmark=[(1, item), (None, item), (2, item + " more"), (3, "a a a a a a a a a a a a"), (4, "lone words here")])
    texts = [(1, item), (1, "clean"), (None, item), (None, "x"), (2, long + " " + item + " " + long), (3, "a " * 500), (4, "LONE words, here! lone words"), (5, item), (5, item), (6, None)]
    out = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in op4_decontamination(spark, docs(texts, extra=True)).collect())
    want = sorted((str(d), w, h, k, c) for d, t in texts for w, h, k, _, c in brute.decontaminated([(d, t)], [(1, item), (None, item), (2, item + " more"), (3, "a " * 12), (4, "lone words here")]).values())
    assert out == want


def test_fingerprints_are_thin_and_whole(spark):
    from textloom.llm.decontamination import fingerprinted

    df = fingerprinted(spark.createDataFrame([(1, prose(3, 2000))], "doc_id long, text string"), 10)
    places = [x.p for x in df.select("prints").first().prints]
    assert 0.2 < len(places) / 2000 < 0.4 and all(b - a <= 6 for a, b in zip(places, places[1:])) and places[0] <= 5 and places[-1] >= 1990


def test_decontamination_without_items(spark, docs, folder):
    folder(benchmark=[])
    assert all(not r.contaminated and r.n_items == 0 for r in op4_decontamination(spark, docs(ODD)).collect())


def test_token_counts(spark, docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*corpus, (950, "a<|endoftext|>b  \n<|endoftext|>"), (951, "it's we'll \u0558\u1c90 x\u0301 ½ ٣ ﷺ"), (952, prose(1, 30_000))]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = got(op6_token_counts(spark, docs(rows, extra=True)))
    for d, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (out[d].n_bytes, out[d].n_tokens, out[d].over_limit) == (len((text or "").encode()), n, n > 512), d
    few = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), most_frequent=3).collect()}
    assert few == {d: out[d].n_tokens for d, _ in rows}


def test_pre_tokens_are_the_librarys():
    c = Cutter("byte_bpe_50k.json")
    pre = c.tokenizer.pre_tokenizer
    r = random.Random(3)
    for at in list(range(0, 0x3000)) + [0xFF01, 0x1F600, 0x1F3FB, 0x10000, 0xE000]:
        s = f"a{chr(at)}1{chr(at)}! {chr(at)}{chr(at)} b"
        assert c.plain(s) == [s[x:y] for _, (x, y) in pre.pre_tokenize_str(s)], hex(at)
    for _ in range(300):
        s = "".join(r.choice("ab 1!\n\t'slé–") for _ in range(20))
        assert c.plain(s) == [s[x:y] for _, (x, y) in pre.pre_tokenize_str(s)], s


def test_piece_encoding(spark, docs, corpus):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    rows = [*corpus, (950, "  two  spaces "), (951, "<s> </s> <unk> <0x0A> ▁"), (952, prose(1, 5000))]
    out = got(op10_piece_encoding(spark, docs(rows, extra=True)))
    for d, t in rows:
        ids = sp.encode(t or "")
        assert (out[d].n_tokens, out[d].ids_sha256, out[d].decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(sp.decode(ids))), d
        assert out[d].n_covered == len((t or "").encode())


def test_spans_are_the_pieces(spark):
    text = "Héllo  wörld\n日本 x"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in encode(df).collect()}
    enc, data = Encoder(MODEL), text.encode()
    for i, a, b in zip(r[1].ids, r[1].starts, r[1].ends):
        p = enc.library.id_to_piece(i)
        if not p.startswith("<0x"):
            assert data[a:b].decode() == p.replace("▁", " ").lstrip(" " if a == 0 else "") or p == "▁"
    assert r[1].decoded == text and list(r[2].ids) == [] and r[2].decoded == ""


def test_normaliser_takes_the_longest_prefix():
    # a trie with the keys a, ab and é: units by place, as a double array
    units = {0: (1 << 10)}
    keys = {b"a": 0, b"ab": 2, "é".encode(): 5}
    pool = b"x\0yz\0e\0"
    place = {b"a": 1 ^ 97, b"\xc3": 1 ^ 0xC3}
    base = {b"a": 512, b"\xc3": 1024}
    units[place[b"a"]] = 97 | 1 << 8 | (place[b"a"] ^ base[b"a"]) << 10
    units[base[b"a"]] = keys[b"a"] | 1 << 31
    ab = base[b"a"] ^ 98
    units[ab] = 98 | 1 << 8 | (ab ^ 768) << 10
    units[768] = keys[b"ab"] | 1 << 31
    units[place[b"\xc3"]] = 0xC3 | (place[b"\xc3"] ^ base[b"\xc3"]) << 10
    e = base[b"\xc3"] ^ 0xA9
    units[e] = 0xA9 | 1 << 8 | (e ^ 1536) << 10
    units[1536] = keys["é".encode()] | 1 << 31
    size = max(units) + 1
    import struct

    blob = struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size))) + pool
    n = Normaliser(blob, dummy_prefix=False, squeeze=True, escape=False)
    out, where = n("  abaé  c ".encode())
    assert out == b"yzxe c" and where.tolist() == [2, 2, 4, 5, 7, 9, 10]


def test_media(spark, docs, corpus):
    out = got(op7_media_sniffing(spark, docs(corpus, extra=True)))
    for d, t in corpus:
        p = padded(t)
        assert len(p) % 192 == 0 and len(p) > 0
        r = out[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), brute.sha(p), zlib.crc32(p[-16:]))


def test_sniffing_carves_and_rejects():
    p = padded("hello BM GIF89a \x89PNG")
    for make, kind in ((to_wav, "audio/wav"), (to_bmp, "image/bmp"), (to_png, "image/png")):
        x = make(p)
        assert sniff_bytes(x) == (kind, len(x), []) and payload_of(x, kind) == p
        got_kind, _, found = sniff_bytes(b"junk" + x + b"RIFFtail" + x)
        assert got_kind is None and found == [(kind, 4, len(x)), (kind, 12 + len(x), len(x))]
        assert sniff_bytes(x[:-8])[0] is None or kind == "audio/wav" and sniff_bytes(x[:-8])[0] is None
    gif = b"GIF89a\x01\0\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x01D\0;"
    assert sniff_bytes(gif)[:2] == ("image/gif", len(gif)) and sniff_bytes(gif[:-1])[0] is None
    import gzip

    z = gzip.compress(b"data" * 50)
    assert sniff_bytes(z + b"rest")[:2] == ("application/gzip", len(z)) and sniff_bytes(None) == (None, 0, [])
    assert len({f[2] for f in FORMATS}) == len(FORMATS)


def test_language(spark, folder):
    r = random.Random(1)
    said = {"en": "the and of that is with house water".split(), "de": "der die und das ist nicht haus wasser".split(), "fr": "le la les et est dans maison eau".split()}
    rows = [(i, " ".join(r.choice(said[g]) for _ in range(40)), g if i % 11 else None, "s", 1) for i in range(300) for g in [list(said)[i % 3]]]
    odd = [(1000 + i, t, None, "s", 1) for i, t in enumerate([None, "", "123 !!", "x", "É", "日本"])]
    out = got(op3_language_id(spark, folder(True, documents=rows + odd)))
    assert sum(out[d].lang_pred == list(said)[d % 3] for d, *_ in rows) == len(rows)
    assert [out[1000 + i].lang_pred == "und" for i in range(6)] == [True, True, True, False, False, False]
    assert all(0 <= x.score <= 1 for x in out.values())
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in out)


@pytest.mark.parametrize("op", [op3_language_id, op4_decontamination, op5_near_duplicates, op6_token_counts, op7_media_sniffing, op9_suffix_repeats, op10_piece_encoding])
def test_empty_and_null_tables(spark, docs, folder, op):
    folder(benchmark=[(1, None)])
    assert op(spark, docs([])).count() == 0
    assert op(spark, docs([(1, None), (2, None), (None, None), (None, "a b c d e f g")], lang=None)).count() == 4


def test_media_is_what_was_stored(spark, docs):
    rows = [(i, "x" * (192 * i + i)) for i in range(9)] + [(20, None), (21, "%PDF-1.4 startxref %%EOF"), (22, "GIF89a"), (23, prose(1, 50_000)), (23, prose(1, 50_000))]
    out = op7_media_sniffing(spark, docs(rows, extra=True)).collect()
    assert len(out) == len(rows)
    text = dict(rows)
    for r in out:
        p = padded(text[r.doc_id])
        name, write = (("audio/wav", to_wav), ("image/bmp", to_bmp), ("image/png", to_png))[len(p) // 192 % 3]
        x = write(p)
        carved = ["application/pdf@" + str(x.index(b"%PDF"))] if r.doc_id == 21 and name != "image/png" else []
        said = name if len((text[r.doc_id] or "").encode()) % 3 else "application/octet-stream"
        want = ";".join([name, "as declared" if said == name else "corrected", ",".join(carved)])
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(x), brute.sha(x), want)


def test_many_beginnings_without_an_end_are_no_work():
    import time

    began = time.perf_counter()
    assert sniff_bytes(b"%PDF-" * 200_000 + b"%%EOF")[0] is None
    assert sniff_bytes(b"PK\x03\x04" * 200_000)[0] is None
    assert time.perf_counter() - began < 10


def brute_language(train, asked):
    """The plain version: exact sets of n-grams instead of slots."""
    import re
    from collections import Counter

    from textloom.llm import language_id as li

    def grams(t):
        low = (t if t.isascii() else t.lower()).encode()
        low = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in low)
        low = re.sub(b" +", b" ", b" " + low + b" ")
        return [low[i : i + li.GRAM] for i in range(len(low) - li.GRAM + 1)]

    n, texts = {}, Counter(g for _, g in train)
    for t, g in train:
        n.setdefault(g, Counter()).update(grams(t))
    rate = {g: {x: k / sum(c.values()) for x, k in c.items()} for g, c in n.items()}
    most = {}
    for c in rate.values():
        for x, r in c.items():
            most[x] = max(most.get(x, 0), r)
    has = {g: {x for x, r in c.items() if n[g][x] >= 2 and r >= li.RATIO * most[x]} for g, c in rate.items()}
    out = []
    for t in asked:
        if not any(map(str.isalpha, t or "")):
            out.append((li.UNKNOWN, 0.0))
            continue
        gs = grams(t)
        found = {g: sum(x in s for x in gs) for g, s in sorted(has.items())}
        best = max(found, key=lambda g: found[g], default=None)
        out.append((best, found[best] / len(gs)) if best is not None and found[best] else (min(texts, key=lambda g: (-texts[g], g), default=li.UNKNOWN), 0.0))
    return out


SAID = {"en": "the and of that is with house water", "de": "der die und das ist nicht haus wasser", "fr": "le la les et est dans maison eau", "it": "il lo gli che non casa acqua ed"}


def speech(seed, lang, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(SAID[lang].split()) for _ in range(n))


def test_language_is_that_of_the_plain_version(spark, docs, monkeypatch):
    from textloom.llm import language_id as li

    rows = [(i, speech(i, list(SAID)[i % 4]), list(SAID)[i % 4]) for i in range(200)]
    asked = [t for _, t, _ in rows] + [None, "", "12 !", "x", "É", "the" * 50_000, speech(1, "en", 30_000), "the the", "qqqqq zzzzz"] * 2
    train = [(t, g) for _, t, g in rows]
    model = li.fit(spark.createDataFrame(train, "text string, lang string"))
    counted = [r.text for r in spark.createDataFrame(train, "text string, lang string").select("text").distinct().where("pmod(xxhash64(text, 'calibration'), 10) <> 0").collect()]
    lang, score, accepted = model.predict(asked)
    want = brute_language([(t, g) for t, g in train if t in counted], asked)
    assert lang == [g for g, _ in want]
    assert max(abs(a - b) for a, (_, b) in zip(score, want)) < 0.02
    assert accepted[:200] == [True] * 200 and accepted[200:209] == [False, False, False, True, True, accepted[205], True, True, True]
    gibberish = " ".join("xqzjkwv"[i % 7] + "kjqxz"[i % 5] + "wvxq" for i in range(60))
    assert model.predict([gibberish])[2] == [False]


def test_language_of_very_many(spark):
    from textloom.llm import language_id as li

    r = random.Random(9)
    words = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(8)] for k in range(150)}
    rows = [(" ".join(r.choice(ws) for _ in range(30)), g) for g, ws in words.items() for _ in range(4)]
    model = li.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.table.shape[0] == 3 and model.predict([t for t, _ in rows])[0] == [g for _, g in rows]


def test_language_sample_keeps_rare_languages(spark):
    from textloom.llm import language_id as li

    assert li.rates({"a": 1000, "b": 10}, 100) == {"b": 1.0, "a": 0.09}
    rows = [(speech(i, "en"), "en") for i in range(300)] + [(speech(i, "de"), "de") for i in range(20)]
    model = li.fit(spark.createDataFrame(rows, "text string, lang string").repartition(7), fit_texts=60)
    again = li.fit(spark.createDataFrame(rows[::-1], "text string, lang string").repartition(3), fit_texts=60)
    assert (model.table == again.table).all() and model.predict([speech(999, "de"), speech(999, "en")])[0] == ["de", "en"]


def test_language_without_labels(spark, docs):
    out = op3_language_id(spark, docs([(1, "some text"), (2, "1"), (3, None)], lang=None)).collect()
    assert {(r.doc_id, r.lang_pred, r.score, r.accepted) for r in out} == {(1, "und", 0.0, True), (2, "und", 0.0, False), (3, "und", 0.0, False)}


def test_language_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = op3_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(out) > 100 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)


def character_map(rules):
    """A compiled character map, as the library reads it: a double-array trie of the keys, then the values."""
    import struct

    pool, units, block = b"", {}, [256]

    def fill(keys, at):
        base = block[0]
        block[0] += 256
        units[at] = units.get(at, 0) | (at ^ base) << 10
        if b"" in keys:
            units[at] |= 1 << 8
            units[base] = keys[b""] | 1 << 31
        for c in {k[0] for k in keys if k}:
            units[base ^ c] = c
            fill({k[1:]: v for k, v in keys.items() if k[:1] == bytes([c])}, base ^ c)

    place = {}
    for key, value in rules.items():
        place[key.encode()] = len(pool)
        pool += value.encode() + b"\0"
    fill(place, 0)
    size = max(units) // 256 * 256 + 256
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size))) + pool


def test_encoding_through_a_character_map(spark, tmp_path):
    """A copy of the model that has a map: ids are the library's, and so is every piece's place in the source."""
    import public_tokenizers
    import sentencepiece

    rules = {"ﬁ": "fi", "Ａ": "A", "½": "1/2", "é": "e", "e\u0301": "e", "ab": "x", "abc": "yz", "\u00ad": "", "\u3000": " "}
    blob = character_map(rules)
    varint = lambda n: bytes([n & 127 | 128, *varint(n >> 7)]) if n > 127 else bytes([n])
    spec = b"\x12" + varint(len(blob)) + blob
    with open(public_tokenizers.path(MODEL), "rb") as f:
        whole = f.read() + b"\x1a" + varint(len(spec)) + spec  # merged with the specification that is there
    path = tmp_path / "mapped.model"
    path.write_bytes(whole)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert sp.encode("ﬁne") == sp.encode("fine")
    enc = Encoder(str(path))
    assert enc.normalise.units and enc.normalise("xabcab".encode())[0].endswith(b"xyzx")
    r = random.Random(7)
    bits = ["ﬁ", "Ａ", "½", "é", "e\u0301", "ab", "abc", "abd", "\u00ad", "\u3000", " ", "the ", "house", "日", "🎉", "e", "\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(200)] + ["", None, "ab" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: x for x in encode(df, str(path)).collect()}
    checked = 0
    for d, t in enumerate(texts):
        t = t or ""
        proto = sp.encode(t, return_type="proto")
        assert list(out[d].ids) == [p.id for p in proto.pieces] and out[d].decoded == sp.decode(list(out[d].ids))
        for p, a, b in zip(proto.pieces, out[d].starts, out[d].ends):
            if not p.piece.startswith("<0x") and p.surface:
                assert (p.begin, p.end) == (a, b), (t, p.piece, a, b)
                checked += 1
    assert checked > 1000


@pytest.mark.parametrize("op", [op3_language_id, op4_decontamination, op5_near_duplicates, op6_token_counts, op7_media_sniffing, op9_suffix_repeats, op10_piece_encoding])
def test_repeated_rows_give_repeated_results(spark, docs, folder, corpus, op):
    from collections import Counter

    folder(benchmark=[(1, prose(77, 60)), (2, corpus[3][1][40:300])])
    rows = [*corpus, (970, prose(11, 20_000))]
    once = Counter(map(tuple, op(spark, docs(rows)).collect()))
    twice = Counter(map(tuple, op(spark, docs(rows * 2, extra=True)).collect()))
    assert twice == Counter({r: 2 * n for r, n in once.items()}) and sum(once.values()) == len(rows)


def test_suffix_repeats_in_many_buckets(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(sr, "BUCKET_BYTES", 10)
    monkeypatch.setattr(sr, "TASK_BYTES", 3_000)
    out = got(op9_suffix_repeats(spark, docs(corpus)))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans) for d, r in out.items()} == {d: v[:3] for d, v in brute.without_repeats(corpus).items()}
