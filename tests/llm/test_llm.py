import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from keylake.llm import fingerprint, line_dedup, lm_scoring, near_dedup, packing, piece_encoding, quality_rules, queries, toxicity, url_filter, warc
from keylake.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two three"), (4, "one two three"), (None, "a null id\nline"), (7, LONG), (8, "x" * 5000), (9, "ties ties ties ties\nties ties")]


@pytest.fixture()
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, "en", None, 0.5, 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, label int")


@pytest.fixture()
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


def test_lm_scores_of_odd_rows(spark, odd, none):
    rows = lm_scoring.op1(spark, odd).collect()
    assert len(rows) == len(ODD) and {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert all(r.mean_log_score is None and r.log_score == 0 for r in rows if r.n_words == 0)
    assert {r.n_trigram for r in rows if r.doc_id == 4} == {1}  # each of two equal rows is known to the other
    assert lm_scoring.op1(spark, none).count() == 0


def test_lm_scores_dont_depend_on_blocks_or_levels(spark):
    docs = table(spark, SF, "documents")
    key = lambda df: {r.doc_id: (r.n_trigram, r.n_bigram, r.n_unigram, round(r.log_score, 4)) for r in df.collect()}
    want = key(lm_scoring.lm_scores(docs))
    assert key(lm_scoring.lm_scores(docs, block_bytes=1 << 15, part_grams=1 << 14)) == want
    assert key(lm_scoring.lm_scores(docs, block_bytes=1 << 16, part_grams=1 << 11, fan=4)) == want  # three levels of sums


def test_lm_exchange_grows_with_the_corpus(spark):
    docs = table(spark, SF, "documents")
    rows = []
    for times in (1, 2, 4):
        blocks, parts, fan = 10 * times, 40 * times, 40
        more = docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("doc_id", F.col("k") * 10**6 + F.col("doc_id"))
        counts = lm_scoring.asked(lm_scoring.gathered(more, blocks), min(parts, fan)).cache()
        up = counts.withColumn("up", F.floor(F.col("block") / fan).cast("int"))
        rows.append((counts.count(), lm_scoring.narrowed(up, fan, -(-parts // fan)).count()))
    assert rows[2][0] <= 4.2 * rows[0][0] and rows[2][1] <= 4.2 * rows[0][1]


def test_a_repeated_row_is_dealt_to_several_blocks(spark):
    docs = spark.range(400).selectExpr("1L AS doc_id", "'the same text again' AS text").repartition(8)
    assert lm_scoring.gathered(docs, 100).select("block").distinct().count() > 4
    assert {(r.n_words, r.n_trigram) for r in lm_scoring.lm_scores(docs, block_bytes=100).collect()} == {(4, 2)}


def test_urls(spark):
    urls = [None, "no scheme", "", "HTTP://A.Example.NET/en/x", "http://b.net", "http://x.org/fr/a?q#f", "http://x.org/frx", "http://cheap-pills.example.org/a", "http://ünï.org/\n/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[3]])], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.op2(spark, pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == got[9] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("b.net", "", None, "allow") and got[5] == ("x.org", "/fr/a", "org/fr/", "allow")
    assert got[7][3] == "allow" and got[6][2] is None
    assert url_filter.op2(spark, pages.limit(0)).count() == 0


def test_list_entries_meet_pages_by_canonical_url_only(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://shop.test/a?b=2&a=1#x", "url"), (2, "https://shop.test/a?b=2", "y"), (3, "http://www.shop.test//a/?a=1&utm_source=q&b=2", "y"), (4, "http://shop.test/" + "z" * 100_000, "y"), (5, "http://x.example.net/en/a", "y"), (5, "http://x.example.net/en/a", "y"), (6, None, None)], "page_id long, url string, canon string")
    listed = spark.createDataFrame([("HTTPS://WWW.shop.test:443/a/?a=1&b=2&ref=1",), ("http://shop.test/" + "z" * 100_000 + "/",), ("http://x.example.net/en/a",), (None,), ("nothing",)], "url string")
    verdicts = lambda: sorted((r.page_id, r.verdict, r.listed) for r in url_filter.judge(pages, listed).collect())
    assert verdicts() == [(1, "block", True), (2, "allow", False), (3, "block", True), (4, "block", True), (5, "allow", True), (5, "allow", True), (6, "allow", False)]
    monkeypatch.setattr(url_filter, "canonical_url", lambda url: url)  # without it entries miss their pages
    assert [v for i, v, _ in verdicts() if i in (1, 3)] == ["allow", "allow"]


def test_broken_filter_changes_verdicts(spark, monkeypatch):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    blocked = url_filter.op2(spark, pages).filter("listed and verdict = 'block' and rule is null").count()
    all_spam = pages.filter(url_filter.host_of(F.col("url")).rlike("casino-win|free-bets|cheap-pills|spam-farm")).count()
    assert 0 < blocked < all_spam
    bits = iter((1, 2))  # the filter's bits are other ones than those that are asked for
    monkeypatch.setattr(url_filter, "_masks", lambda key, real=url_filter._masks: [F.lit(b).cast("long") for b in [next(bits)] * 4])
    assert url_filter.op2(spark, pages).filter("listed").count() == 0


def test_bloom_filter_alone_loses_nothing(spark):
    listed = spark.range(3000).selectExpr("concat('h/', id) AS canon")
    urls = spark.range(6000).selectExpr("id", "concat('h/', id) AS canon")
    for blocks in (1, 8, 1 << 18):  # a full filter lets all through to the exact join
        got = url_filter.listed_flags(urls, listed, blocks)
        assert {r.id for r in got.filter("listed").collect()} == set(range(3000)) and got.count() == 6000


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 800
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (None, "u", big), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.op3(spark, pages).collect()), key=repr)
    sha = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    want = [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None)]
    assert [x[:3] for x in got] == want and got[0][3:] == (1603, sha(big)) and got[4][3:] == (0, sha(""))
    assert warc.op3(spark, pages.limit(0)).count() == 0


def test_warc_of_clashing_columns_and_a_very_long_page(spark):
    pages = spark.createDataFrame([(1, "u", "z" * 3_000_000, "x", 5), (2, "u" * 50_000, "z" * 3_000_000, "y", 6)], "page_id long, url string, html string, record_type string, payload_bytes int")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.op3(spark, pages).collect()}
    assert got == {1: ("revisit", 2, 3_000_000), 2: ("response", None, 3_000_000)}


def test_archives_round_trip_with_their_dictionary(tmp_path):
    records = [warc.warc_record(i, f"http://h/{i}", (f"<html>page {i} " + "common words of a page " * 20).encode(), None) for i in range(300)]
    with open(tmp_path / "a.warc.zst", "wb") as f:
        warc.write_archive(f, records)
    with open(tmp_path / "a.warc.zst", "rb") as f:
        assert f.read(4) == (0x184D2A5D).to_bytes(4, "little")
        f.seek(0)
        assert list(warc.read_archive(f)) == records


def test_near_classes_equal_brute_force(spark):
    want = brute.near_classes(texts(spark))
    assert {r.doc_id: r.class_id for r in near_dedup.op4(spark, table(spark, SF, "documents")).collect()} == want


def cloud(seed, n=120, words=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(words)]
    pool = [base]
    for _ in range(n):
        own = list(r.choice(pool[:6]) if r.random() < 0.4 else base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8, 10])):
            own[r.randrange(len(own))] = word()
        pool.append(own)
    return [" ".join(x) for x in pool]


@pytest.mark.parametrize("seed, n, words", [(1, 120, 150), (2, 1000, 60)])
def test_dense_groups_equal_brute_force(spark, seed, n, words):
    found = dict(enumerate(cloud(seed, n, words)))
    docs = spark.createDataFrame(list(found.items()), "doc_id long, text string")
    want = brute.near_classes(found)
    assert len(set(want.values())) > n / 10
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == want


def families(seed, n=500):
    """Copies of three related texts, with words replaced, left out, cut off at an end, or with a passage that several share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(80)]
    bases = [base, base[:60] + [word() for _ in range(20)], [word() for _ in range(12)] + base[12:]]
    passages = [[word() for _ in range(25)] for _ in range(3)]
    out = []
    for _ in range(n):
        own = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            at, kind = r.randrange(len(own)), r.random()
            if kind < 0.4:
                del own[at]
            elif kind < 0.6:
                own[at] = r.choice("xyz") * 3  # few words, so copies share changes by chance
            else:
                own[at] = word()
        if r.random() < 0.4:
            own = own[: len(own) - r.randrange(1, 22)]
        if r.random() < 0.3:
            own += r.choice(passages)[: r.randrange(8, 25)]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_families_equal_brute_force(spark, seed):
    found = dict(enumerate(families(seed)))
    docs = spark.createDataFrame(list(found.items()), "doc_id long, text string")
    want = brute.near_classes(found)
    assert 5 < len(set(want.values())) < len(found) - 100
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == want


def test_no_link_is_lost_without_hubs_or_stars(spark, monkeypatch):
    """One bucket of all nodes, and only postings to find links beyond the hub's and the centre's."""
    monkeypatch.setattr(near_dedup, "stars", lambda rows, near: near_dedup.candidates(rows.limit(0), rows, near))
    found = dict(enumerate(families(7, 400)))
    docs = near_dedup.keyed(spark.createDataFrame(list(found.items()), "doc_id long, text string"))
    prints = near_dedup.stored(near_dedup.signed(docs))
    shingles = near_dedup.stored(near_dedup.shingled(docs).groupBy("node").agg(F.first("units").alias("units"), F.first("size").alias("size")))
    labels = near_dedup.classes_of(prints.select(F.lit(1).alias("key"), "node", F.abs(F.col("node") % 1000).alias("w")).distinct(), shingles)
    got = {r.doc_id: r.label for r in prints.join(labels, "node").collect()}
    want = brute.near_classes(found)
    assert len(set(want.values())) == len(set(got.values())) == len(set((want[i], got[i]) for i in found))


def test_near_classes_of_odd_rows(spark, odd, none):
    got = [(r.doc_id, r.class_id) for r in near_dedup.near_classes(odd).collect()]
    assert len(got) == len(ODD) and {c for i, c in got if i in (1, 2, 3)} == {1}
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert near_dedup.near_classes(none).count() == 0 and near_dedup.deduplicated(none).count() == 0


def test_dart_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = rng.uniform(0.1, 4, 400), rng.uniform(0.1, 4, 400)
    b[:250] = a[:250]
    sig = near_dedup.dart_minhash(np.concatenate([ids, ids]), np.concatenate([a, b]), np.repeat([0, 1], 400), 2, 2048, 2048 * 10)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_unseen_misspellings_are_toxic_too(spark):
    rng = random.Random(3)
    good = [f"{a}{b}" for a in ("lor", "dol", "amet", "sit", "cons", "adip", "elit", "sed") for b in ("em", "or", "ur", "is", "ec", "am", "us", "ent")]
    rows = []
    for i in range(600):
        words = [rng.choice(good) for _ in range(rng.randrange(10, 60))]
        if i % 3 == 0:
            bad = ["worthless", "disgusting", "pathetic"]
            if toxicity_held_out(i):  # spelt as no document to learn from spells them
                bad = ["worthlesss", "w0rthless", "disgustingg", "d1sgusting", "patheticc", "pathetik"]
            words += [rng.choice(bad) for _ in range(3)]
            rng.shuffle(words)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = [r for r in toxicity.op5(spark, docs, docs).collect() if r.held_out]
    caught = [r.predicted for r in held if r.doc_id % 3 == 0]
    assert len(caught) > 40 and sum(caught) >= 0.9 * len(caught)
    assert sum(r.predicted for r in held if r.doc_id % 3) <= 0.02 * len(held)


def toxicity_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity(spark, odd, none):
    rng = random.Random(1)
    bad, good = ["idiot", "moron", "pathetic"], [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = [rng.choice(good) for _ in range(rng.randrange(5, 60))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.op5(spark, docs, docs.select("doc_id", "toxic")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in got if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    out = toxicity.op5(spark, odd, docs.select("doc_id", "toxic"))
    assert out.count() == len(ODD) and out.filter("score is null").count() == 0
    assert toxicity.op5(spark, none, docs.select("doc_id", "toxic")).count() == 0
    assert {r.score for r in toxicity.op5(spark, odd, docs.select("doc_id", "toxic").limit(0)).collect()} == {0.0}
    assert toxicity.accepted(odd, None).columns == odd.columns


def test_piece_encoding_equals_the_library(spark, odd, none):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    more = [" a", "a  b   c", "▁ x", "\u0000​ é ñ 日本語 🎉", "aaaaaaaaaaaaaaaa" * 40]
    odd = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for docs in (odd, table(spark, SF, "documents")):
        found = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in piece_encoding.op6(spark, docs, path).collect()}
        want = set()
        for r in docs.collect():
            ids = sp.encode(r.text or "")
            want.add((r.doc_id, sha(",".join(map(str, ids))), sha(sp.decode(ids)), len(ids)))
        assert found == want
    assert piece_encoding.op6(spark, none, path).count() == 0


def piece_model(pieces):
    """A tiny BPE model: its pieces with their scores, and the bytes."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 2, True
    m.normalizer_spec.remove_extra_whitespaces = m.normalizer_spec.add_dummy_prefix = False
    m.normalizer_spec.name = "identity"
    kinds = pb.ModelProto.SentencePiece
    for name, kind in (("<unk>", kinds.UNKNOWN), ("<s>", kinds.CONTROL), ("</s>", kinds.CONTROL), *((f"<0x{b:02X}>", kinds.BYTE) for b in range(256))):
        m.pieces.add(piece=name, score=0, type=kind)
    for name, score in pieces:
        m.pieces.add(piece=name, score=score, type=kinds.NORMAL)
    return m


def test_ties_of_longer_pieces_are_merged_as_the_library_does():
    import sentencepiece

    m = piece_model([("ab", -1), ("bc", -1), ("abc", -2), ("ca", -3), ("a", -4), ("b", -5), ("c", -6)])
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    model = piece_encoding.PieceModel(m.SerializeToString())
    assert model.tied == {"ab", "bc"}
    rng = random.Random(2)
    for text in ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(300)]:
        assert model.encode(text) == sp.encode(text), text
    m.pieces[-1].type = type(m.pieces[0]).USER_DEFINED
    with pytest.raises(ValueError):
        piece_encoding.PieceModel(m.SerializeToString())


def test_fingerprints(spark, odd, none):
    rows = sorted(texts(spark).items())
    got = {r.doc_id: r for r in fingerprint.op7(spark, table(spark, SF, "documents")).collect()}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b = set(brute.shingles(t)), set(brute.shingles(new))
        assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.2
    out = fingerprint.op7(spark, odd).collect()
    assert len(out) == len(ODD) and len({r.fingerprint for r in out if r.doc_id == 4}) == 1
    assert fingerprint.op7(spark, none).count() == 0


def test_fingerprints_equal_plain_ones(spark):
    from keylake.llm.words import mixed, shingles

    f = fingerprint.Fingerprinter()
    mix = lambda x: int(mixed(np.array([x], np.uint64))[0])
    pick = lambda b, k: mix((b << 32) + k + 0x1234567) % f.bins
    plain = lambda t: brute.one_permutation([int(h) for h in shingles([t.encode()])[0]], f.bins, f.bits, pick, mix)
    rows = sorted((i, t or "") for i, t in texts(spark).items())[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.op7(spark, docs).collect()}
    share = lambda a, b: sum(x == y for x, y in zip(a, b)) / f.bins
    corrected = lambda s: max(0.0, (s - 1 / 16) / (15 / 16))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        own, other = plain(t), plain(fingerprint.edited(t, after))
        assert f.unpacked(got[i].fingerprint).tolist() == own and f.unpacked(got[i].edited_fingerprint).tolist() == other
        assert abs(got[i].near_edited - corrected(share(own, other))) < 1e-9 and abs(got[i].near_next - corrected(share(own, plain(after)))) < 1e-9


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for docs in (odd, table(spark, SF, "documents")):
        rows = packing.op8(spark, docs, path).collect()
        want = []
        for d in docs.collect():
            ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
            want += [(d.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=repr) == sorted(want, key=repr)
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in by.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 2
    assert packing.op8(spark, none, path).count() == 0
    with open(path, "rb") as f:
        known = packing._WordIds(f.read())
    odd_words = ["<|endoftext|>", "x<|startoftext|>y", "don't", "a\u00a0b", "\u200b", "e\u0301", "\u3000", "🎉", "日本語", "İ", "x" * 5000, "\x00", "\x1c"]
    assert known.ids_of([w.encode() for w in odd_words]) == {w.encode(): np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in odd_words}


def pieces_of(spark, lengths):
    return spark.createDataFrame([(i, i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECE)


def test_the_genetic_algorithm_betters_best_fit(spark):
    plain = evolved = bound = 0
    for seed in (2, 9, 15, 23):
        r = np.random.default_rng(seed)
        lengths = np.sort(r.integers(15, 60, int(r.integers(30, 120))))[::-1]
        p = packing.Packer(lengths, 100, 0)
        plain -= p.score(p.first(0))[0]
        bound += p.bound
        rows = packing.packed(pieces_of(spark, lengths), capacity=100).collect()
        fill = {}
        for x in rows:
            fill[x.sequence_id] = fill.get(x.sequence_id, 0) + x.length
        assert sorted(x.length for x in rows) == sorted(lengths.tolist()) and max(fill.values()) <= 100
        evolved += len(fill)
    assert bound <= evolved <= plain - 3


def test_crossover_keeps_every_piece_and_migrants_arrive():
    import pandas as pd

    r = np.random.default_rng(2)
    lengths = np.sort(r.integers(15, 60, 105))[::-1]
    p = packing.Packer(lengths, 100, 1)
    a, b = p.first(0.3), p.first(0.3)
    for _ in range(20):
        child = p.cross(a, b)
        assert len(child) == len(lengths) and np.bincount(child, lengths).max() <= 100
        a, b = b, child
    founded = packing._founded(100, 2, 5)(pd.DataFrame({"shard": 0, "length": lengths, "deal": range(len(lengths))}))
    assert len(founded) == 2 and all(len(x) == 5 for x in (packing._unpack(raw, len(lengths)) for raw in founded["population"]))
    sent = packing._epoch(2, 5, 3, 0, True)(founded[founded.island == 0])
    assert sent["island"].tolist() == [0, 1]  # the island itself, and its elite for the next one
    elite = packing._unpack(sent["population"].iloc[1], len(lengths))
    assert len(elite) == 1 and p.score(elite[0]) == max(map(p.score, packing._unpack(sent["population"].iloc[0], len(lengths))))


def test_runs_are_merged_and_batches_skip_settled_lines(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", fanout=2)
    docs = lambda ids: spark.createDataFrame([(i, f"shared\nown {i}") for i in ids], "doc_id long, text string")
    for k in range(5):
        runs.add(line_dedup.line_rows(docs(range(4 * k, 4 * k + 4))), min_docs=8)
    assert sorted(level for level, _ in runs.runs) == [0, 2]
    counts = sorted(r.n for r in runs.counts().collect())
    assert counts == [1] * 20 + [8]  # after two batches the shared line is settled
    files = [f for _, name in runs.runs for f in (tmp_path / "runs" / name).glob("*.parquet")]
    for f in files:
        keys = [(r.h1, r.h2) for r in spark.read.parquet(str(f)).collect()]
        assert keys == sorted(keys)
    again = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", fanout=9, runs=runs.runs)
    again.add(line_dedup.line_rows(docs(range(50, 52))), min_docs=8)
    assert len(set(name for _, name in again.runs)) == 3 and again.frequent(8).count() == 1


def test_line_dedup_of_odd_rows(spark, odd, none):
    got = {r.doc_id: r for r in line_dedup.op9(spark, odd).collect()}
    assert got[1].n_lines == got[2].n_lines == 1 and got[1].n_dropped == 0
    rows = [(i, f"own {i}\n Shared LINE \t\n\nshared line") for i in range(10)]
    out = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out} == {(i, 4, 2, f"own {i}\n") for i in range(10)}
    assert line_dedup.cleaned(odd).columns == odd.columns and line_dedup.op9(spark, none).count() == 0


def rule_rows(seed, n=900):
    """Bad by a conjunction of two statistics, by another one, and a little at random."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        r = {s: round(rng.random(), 4) for s in quality_rules.STATS}
        bad = (r["symbol_ratio"] > 0.5 and r["digit_ratio"] > 0.6) or (r["upper_ratio"] > 0.8 and r["mean_word"] < 0.5) or rng.random() < 0.004
        rows.append(r | {"bad": int(bad), "grow": i % 3 != 0})
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decision_lists_equal_plain_covering(spark, seed):
    rows = rule_rows(seed)
    df = spark.createDataFrame([tuple(r[c] for c in (*quality_rules.STATS, "bad", "grow")) for r in rows], ", ".join(f"{s} double" for s in quality_rules.STATS) + ", bad int, grow boolean").coalesce(1).cache()
    cuts = quality_rules._cuts(df)
    for stat, at in cuts.items():  # about the quantiles
        middle = float(np.median([r[stat] for r in rows]))
        assert min(abs(c - middle) for c in at) < 0.03 and len(at) >= quality_rules.BINS
    want = brute.decision_list(rows, cuts)
    rules = quality_rules.learn_rules(df)
    assert [[(t.stat, t.at_least, t.threshold) for t in r.tests] for r in rules] == want
    assert len(want) >= 2 and max(map(len, want)) >= 2
    kept = [r.keep for r in df.select(quality_rules.verdict(rules).alias("keep")).collect()]
    assert kept == [not any(all((r[s] >= c) == up for s, up, c in rule) for rule in want) for r in rows]
    wrong = sum(k == bool(r["bad"]) for k, r in zip(kept, rows))
    assert wrong <= 0.06 * len(rows)


def test_pruning_cuts_a_rule_that_grew_too_far(spark):
    rows = [{s: 0.0 for s in quality_rules.STATS} | {"symbol_ratio": i % 20 / 20, "bad": int(i % 20 >= 10), "digit_ratio": (i * 7 % 10) / 10, "grow": i % 3 != 0} for i in range(600)]
    for r in rows:  # among the rows to grow on, a second test seems to help
        if r["grow"] and r["symbol_ratio"] >= 0.5 and r["digit_ratio"] < 0.3:
            r["bad"] = 0
    df = spark.createDataFrame([tuple(r[c] for c in (*quality_rules.STATS, "bad", "grow")) for r in rows], ", ".join(f"{s} double" for s in quality_rules.STATS) + ", bad int, grow boolean").coalesce(1)
    grown = quality_rules._grow(df.filter("grow"), quality_rules._cuts(df), 3, 5)
    rules = quality_rules.learn_rules(df)
    assert len(grown.tests) == 2 and len(rules[0].tests) == 1
    assert [[(t.stat, t.at_least, t.threshold) for t in r.tests] for r in rules] == brute.decision_list(rows, quality_rules._cuts(df))


def test_quality_counts_equal_plain_ones(spark, odd, none):
    labels = table(spark, SF, "labels")
    for docs in (odd, table(spark, SF, "documents")):
        rows = docs.select("doc_id", "text").collect()
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs, labels).collect()), key=repr)
        want = []
        for r in rows:
            words, lines = brute.WORD.findall(r.text or ""), [x for x in (r.text or "").split("\n") if brute.WORD.search(x)]
            windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
            twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 5000 else None
            if twice is None:
                from collections import Counter

                twice = {w for w, n in Counter(windows).items() if n > 1}
            repeated = {j for i, w in enumerate(windows) if w in twice for j in (i, i + 1, i + 2)}
            want.append((r.doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words)))
        assert got == sorted(want, key=repr)
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.accepted(odd, labels.limit(0)).columns == odd.columns


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark):
    import corpus_pipeline

    start = table(spark, SF, "documents")
    rows = [(i, t, None if k % 2 else "en", None, None) for k, (i, t) in enumerate(ODD)]
    odd = spark.createDataFrame(rows, start.schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if stage is not corpus_pipeline.pack:
                assert out.columns == start.columns
            assert out.count() <= 200 and (docs is odd or out.count() == 0)


def test_line_stage_equals_a_plain_version(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    found = {r.doc_id: (r.text or "").split("\n") for r in docs.collect()}
    holders = {}
    for i, lines in found.items():
        for k in {key(x) for x in lines} - {""}:
            holders[k] = holders.get(k, 0) + 1
    want = {i: "\n".join(x for x in lines if holders.get(key(x), 0) < 10) for i, lines in found.items()}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_shared_lines(spark, docs, SF).collect()} == want


def test_pipeline_keeps_columns_and_packs_what_is_left(spark):
    import corpus_pipeline

    docs = start = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), start.schema)
        assert docs.columns == start.columns and 0 < docs.count() <= before.count()
    assert len(set(brute.near_classes({r.doc_id: r.text for r in docs.collect()}).values())) == docs.count()
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
