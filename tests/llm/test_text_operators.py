"""The operators on texts against brute force; nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweave.llm import blocks, bwt, kneser_ney, mixing, ogg, partenum, range_coder, viterbi
from strataweave.llm.common import components, flat_bytes

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in texts], DOC)


def words(r, n, kinds=400):
    return " ".join(f"w{r.randrange(kinds)}" for _ in range(n))


ODD = [(900, None), (901, ""), (902, "  \n\t "), (903, "one two"), (904, "One TWO"), (905, "é 𝄞 ▁ x"), (906, "a" * 5000), (906, "a" * 5000), (None, "no id here at all today"), (None, None)]


# --- op 1 ---------------------------------------------------------------------------------------------------------


def slow_checksum(page):
    r = 0
    for b in page:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_ogg_pages():
    r = random.Random(1)
    for n in (0, 1, 255, 1000):
        data = r.randbytes(n)
        assert ogg.page_checksum(data) == slow_checksum(data)
    for sizes in ([5, 0, 255, 510, 255 * 255, 255 * 255 * 2 + 3, 10], [0], [255 * 255]):
        packets = [(r.randbytes(n), i * 100) for i, n in enumerate(sizes)]
        streams = ogg.demux(ogg.mux({9: packets, 4: [(b"x", 0)]}))
        assert [p.data for p in streams[9].packets] == [d for d, _ in packets] and streams[9].last_granule == 100 * (len(sizes) - 1)
    media = ogg.store(ogg.pad(b"abc" * 5000), 15000)
    for at in (5, 30, len(media) // 2, len(media) - 1):
        with pytest.raises(ogg.OggError):
            ogg.load(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ogg.OggError):
        ogg.load(media[:-10])


def test_ogg_column(llm):
    rows = ogg.media_column(docs(llm, ODD)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        payload, n, _, _ = ogg.load(bytes(r["media"]))
        assert (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) == (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])
        assert len(payload) % 64 == 0 and len(payload) >= 64 and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert ogg.media_column(docs(llm, ODD).limit(0)).isEmpty()


# --- op 2 ---------------------------------------------------------------------------------------------------------


def shingle_set(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= 75 * len(a | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None] if sets[i] else [doc] if doc is not None else []
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chain_sets", [4096, 2])
def test_jaccard_join(llm, chain_sets):
    r = random.Random(7)
    base = [words(r, r.choice([4, 6, 20, 80, 300])) for _ in range(25)]
    shared = words(r, 60)
    rows = []
    for i in range(110):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        if r.random() < 0.3:
            w += shared.split()
        rows.append((i, " ".join(w)))
    rows += ODD
    found = partenum.jaccard_join(docs(llm, rows), chain_sets=chain_sets)
    assert sorted((tuple(x) for x in found.collect()), key=str) == brute_components(rows)


def test_jaccard_join_of_nothing(llm):
    assert partenum.jaccard_join(docs(llm, ODD).limit(0)).isEmpty()


def test_signatures_meet():
    """Sets with at most k differences share a signature that both keep, whichever of them the guarantee fails."""
    r = random.Random(5)
    failed = 0
    for n in (4, 5, 6, 8, 14, 20, 40, 100, 200, 700):
        lows = partenum.bands(2 * n + 2)
        b = int(np.searchsorted(lows, n, side="right")) - 1
        high = int(lows[b + 1]) - 1
        k = partenum.differences(high)
        n1, n2, k2 = partenum.partition(high)
        assert n2 > 1 and k2 > 0 or k == 0
        for _ in range(60 if k else 0):
            a = [r.randrange(1 << 63) for _ in range(n)]
            c = a[k // 2 :] + [r.randrange(1 << 63) for _ in range(k - k // 2)]
            sets = [np.array(x, np.uint64) for x in (a, c)]
            (sa, spare), (sc, other) = (partenum.signatures(x, b, high) for x in sets)
            both = set(sa.tolist()) & set(sc.tolist())
            failed += spare < 0
            if max(spare, other) >= 0:
                assert len(both) > max(spare, other)
            # the rarest of what they share is kept by both, for any frequencies
            lists = [list(partenum.entries(x, b, high)) for x in sets]
            weight = {}
            kept = []
            for one in lists:
                mine = set()
                for token, needed in one:
                    order = sorted(token.tolist(), key=lambda t: (weight.setdefault(t, r.random()), t))
                    mine |= set(order[:needed])
                kept.append(mine)
            assert kept[0] & kept[1]
    assert failed  # the case is met


def test_hot_join(llm, monkeypatch):
    from strataweave.llm import common

    rows = llm.createDataFrame([(i, "a" if i < 90 else str(i)) for i in range(120)], "doc_id long, k string")
    named = rows.groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("times"))
    expected = sorted((i, "a" if i < 90 else str(i), 0 if i < 90 else i) for i in range(120))
    for most in (7, 1000):
        monkeypatch.setattr(common, "HOT_ROWS", most)
        assert sorted(tuple(x) for x in common.hot_join(rows, named, "k", "times").select("doc_id", "k", "first").collect()) == expected


def test_components(llm):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    parent = {x: x for p in pairs for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    got = {x["node"]: x["component"] for x in components(llm.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}


# --- op 3 ---------------------------------------------------------------------------------------------------------


def test_mixing(llm):
    rows = [(i, "x" * 10, "en", "a" if i % 3 else None, 10) for i in range(3000)] + [(9000, None, "en", "empty", 0), (None, "x" * 10, "en", "a", 10)]
    df = llm.createDataFrame(rows, DOC).withColumn("rate", F.lit("clash")).withColumn("copy", F.lit(1))
    mixed = mixing.mix_sources(df, weights={"a": 1.0, None: 3.0}).cache()
    by = {r["source"]: (r["n"], r["rate"]) for r in mixed.groupBy("source").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).collect()}
    assert set(by) == {"a", None} and abs(by[None][0] / by["a"][0] - 3) < 0.3
    assert abs(by[None][1] - 0.75 * 30010 / 10000) < 1e-9
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate", "copy", "shuffle_key"]
    # the counts are the inverted Poisson distribution
    import math

    n = {r["doc_id"]: r["count"] for r in mixed.where("source is null").groupBy("doc_id").count().collect()}
    lam = by[None][1]
    for i in range(0, 600, 3):
        u = int(hashlib.md5(f"{i}|11".encode()).hexdigest()[:13], 16) / 2**52
        k, cdf = 0, math.exp(-lam)
        while cdf <= u:
            k += 1
            cdf += math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))
        assert n.get(i, 0) == k
    assert mixing.mix_sources(df.limit(0)).isEmpty()
    again = mixing.mix_sources(df.repartition(7), weights={"a": 1.0, None: 3.0})
    assert again.exceptAll(mixed).isEmpty() and mixed.exceptAll(again).isEmpty()
    joined = mixing.MAX_LITERAL_SOURCES
    mixing.MAX_LITERAL_SOURCES = 0
    try:
        assert mixing.mix_sources(df, weights={"a": 1.0, None: 3.0}).select(*mixed.columns).exceptAll(mixed).isEmpty()
    finally:
        mixing.MAX_LITERAL_SOURCES = joined


# --- op 4 ---------------------------------------------------------------------------------------------------------


def small_vocabulary():
    pieces = [" a", "a", "ab", "b", "abc", "c", " ", " b", "bc", "cab"]
    return viterbi.Vocabulary({p: (i, -((i * 7) % 10) - 1) for i, p in enumerate(pieces)}, list(range(100, 356)), [p.encode() for p in pieces] + [b""] * 90 + [bytes([i]) for i in range(256)])


def best_score(v, text):
    best = [0] + [None] * len(text)
    for j in range(1, len(text) + 1):
        options = [best[i] + v.pieces[text[i:j]][1] for i in range(j) if text[i:j] in v.pieces]
        if text[j - 1] not in v.pieces:
            options.append(best[j - 1] + v.unknown)
        best[j] = max(options)
    return best[-1]


def test_streaming_search():
    v, r = small_vocabulary(), random.Random(3)
    score = {i: s for i, s in v.pieces.values()}
    for _ in range(300):
        text = "".join(r.choice("abc é") for _ in range(r.randrange(1, 60)))
        search, ids = viterbi.Search(v), []
        at = 0
        while at < len(text):
            step = r.randrange(1, 9)
            ids += search.feed(text[at : at + step])
            at += step
        ids += search.finish()
        assert b"".join(v.texts[i] for i in ids).decode() == text
        assert sum(score.get(i, 0) for i in ids) + sum(v.unknown for c in text if c == "é") == best_score(v, text)
    search = viterbi.Search(v)
    out = search.feed("abcab " * 5000)
    assert len(out) > 5000 and search.widest < 5 * v.longest + 6 and len(search.text) <= 4 * v.longest


def test_sentencepiece_column(llm):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    r = random.Random(1)
    rows = [*ODD, *[(i, words(r, 50) + "\n" + words(r, 5)) for i in range(20)]]
    got = viterbi.encode_column(docs(llm, rows).withColumn("ids", F.lit("clash")), path).cache()
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_ids", "decoded_crc32"] and got.count() == len(rows)
    for x in got.collect():
        assert x["n_ids"] == len(x["ids"]) and x["decoded_crc32"] == zlib.crc32((x["text"] or "").encode())
    back = viterbi.decode_column(got.select("doc_id", F.col("text").alias("was"), "ids"), path)
    assert back.where("not (text <=> coalesce(was, ''))").isEmpty()
    # the library's own unigram search over the same pieces and scores
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    proto.ParseFromString(open(path, "rb").read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:  # beside -1e9 the library's 32-bit sums lose the others' differences
        piece.score = max(piece.score, -40000.0)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    tool = viterbi.encoder(path)
    for text in ["the quick brown fox", "antidisestablishmentarianism and more of it", words(r, 200)]:
        ids, _ = tool.encode(*flat_bytes(pa.array([text])))
        assert ids.tolist() == library.encode(text)


def test_fractional_scores(tmp_path):
    """A vocabulary of a unigram model, scores as logarithms, more pieces than 16 bits number: the library's own ids."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    import sentencepiece

    r, kinds = random.Random(5), proto.SentencePiece
    proto.pieces.add(piece="<unk>", score=0.0, type=kinds.UNKNOWN)
    for i in range(256):
        proto.pieces.add(piece=f"<0x{i:02X}>", score=0.0, type=kinds.BYTE)
    mark, known = viterbi.SPACE, set("abcdefgh") | {viterbi.SPACE}
    for n, size in ((60, 2), (300, 3), (400, 4), (300, 5)):
        known |= {r.choice(["", mark]) + "".join(r.choice("abcdefgh") for _ in range(size)) for _ in range(n)}
    for x in sorted(known - {"gah"}):
        proto.pieces.add(piece=x, score=-round(256 * (2 + 2.5 * len(x) ** 0.5 + 3 * r.random())) / 256)  # 32-bit sums of these are exact
    for i in range(66_000):  # never met, but later pieces get ids beyond 65,535
        proto.pieces.add(piece=f"z{i:x}z", score=-30.0)
    proto.pieces.add(piece="gah", score=-1.25)
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = True
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.escape_whitespaces = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    library, tool = sentencepiece.SentencePieceProcessor(model_file=path), viterbi.Encoder(viterbi.Vocabulary.load(path))
    texts = [" ".join("".join(r.choice("abcdefghé") for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(1, 40))) for _ in range(400)] + ["gah gahgah"]
    ids, n = tool.encode(*flat_bytes(pa.array(texts)))
    at = np.append(0, np.cumsum(n))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(x) for x in texts]
    assert ids.max() > 65_535


# --- op 5 ---------------------------------------------------------------------------------------------------------


def brute_removed(rows):
    first = {}
    for i, t in sorted(set(rows), key=lambda x: x[0]):
        b = (t or "").encode()
        for j in range(len(b) - 99):
            first.setdefault(b[j : j + 100], (i, j))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            if first[b[j : j + 100]] < (i, j):
                gone[j : j + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot,many", [(2000, 10_000), (2, 10_000), (2, 3)])
def test_suffix_array_dedup(llm, hot, many):
    r = random.Random(4)
    base = "".join(r.choice("abcdé ") for _ in range(900))
    rows = []
    for i in range(60):
        t = "".join(r.choice("abc") for _ in range(r.randrange(150)))
        for _ in range(r.randrange(4)):
            a = r.randrange(600)
            t += base[a : a + r.randrange(20, 300)] + r.choice(["", "x", "é"])
        rows.append((i, t))
    rows += [(60, "a" * 500), (61, "ab" * 200), (62, None), (63, ""), (64, "a" * 99), (65, rows[3][1]), (65, rows[3][1]), (66, "b" * 100)]
    got = sorted(tuple(x) for x in bwt.removed_bytes(docs(llm, rows), hot=hot, many=many).collect())
    assert got == brute_removed(rows)
    kept = bwt.kept_text(docs(llm, rows), hot=hot, many=many)
    by = {x[0]: x for x in got}
    for x in kept.collect():
        n = len((x["text"] or "").encode())
        assert by[x["doc_id"]][1] - by[x["doc_id"]][2] <= n <= by[x["doc_id"]][1] - by[x["doc_id"]][2] + 3 * 2 * by[x["doc_id"]][3]
        assert x["n_chars"] == (None if x["text"] is None else len(x["text"]))
    assert bwt.removed_bytes(docs(llm, rows).limit(0)).isEmpty()
    odd = bwt.removed_bytes(docs(llm, ODD)).collect()
    assert len(odd) == len(ODD) and sorted(x["n_removed"] for x in odd)[-1] == 4999


def test_merged_transforms():
    """Groups of the merge are the equal windows of all shards."""
    r = np.random.RandomState(0)
    size = r.randint(100, 160, 40)
    data = r.randint(97, 99, int(size.sum())).astype(np.uint8)
    data[-400:] = np.tile(data[:100], 4)
    string, offset = bwt.repeats(data, size, size - 99, np.arange(40), np.zeros(40, np.int64), shard_bytes=700)
    seen, expected, at = set(), set(), 0
    for i, n in enumerate(size):
        for j in range(n - 99):
            w = data[at + j : at + j + 100].tobytes()
            if w in seen:
                expected.add((i, j))
            seen.add(w)
        at += n
    assert set(zip(string.tolist(), offset.tolist(), strict=True)) == expected and expected


# --- op 7 ---------------------------------------------------------------------------------------------------------


def test_text_blocks(llm):
    page = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class=ad>Buy the best of all boats right now, you.</div><article><h1>A &amp; B</h1><p><b>One\n two&nbsp;three <a href=x>four</a>.<br><p>Yes.</article><div id=comments><p>I agree with all of this, really.</p></div><footer>&copy; x</footer>"
    assert blocks.main_text(page) == "A & B One two three four. Yes."
    assert blocks.main_text(None) == blocks.main_text("") == blocks.main_text("<p") == ""
    assert blocks.main_text("<article>" + "<p>word</p>" * 20000) == " ".join(["word"] * 20000)
    pages = llm.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = blocks.extract(pages).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 0, 30, 30] and blocks.extract(pages.limit(0)).isEmpty()


# --- op 8 ---------------------------------------------------------------------------------------------------------


def test_kneser_ney(llm):
    r = random.Random(6)
    bad = ["grunzel", "grunzelig", "foobarsk", "snorf"]

    def text(toxic):
        w = words(r, r.randrange(30, 120), 60).split()
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(bad))
        return " ".join(w)

    labels = {i: int(i % 5 == 0) for i in range(800)}
    rows = [*[(i, text(t)) for i, t in labels.items()], *ODD]
    known = llm.createDataFrame([*labels.items(), (5, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = kneser_ney.fit(docs(llm, rows), known)
    got = kneser_ney.score(docs(llm, rows).withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(rows)
    held = [(labels[x["doc_id"]], x["predicted"]) for x in got if x["held_out"] and x["doc_id"] in labels]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in got)
    nothing = kneser_ney.fit(docs(llm, rows), known.limit(0))
    assert {x["predicted"] for x in kneser_ney.score(docs(llm, rows), nothing).collect()} == {0}
    assert kneser_ney.score(docs(llm, rows).limit(0), model).isEmpty()


def test_symbol_codes():
    code = kneser_ney.symbols(np.frombuffer(b"abcdefgh", np.uint8), np.array([8, 0]))
    assert len(code) == 10 and kneser_ney.length(code).tolist() == [2, 3, 4, 5, 6, 6, 6, 6, 6, 2]
    assert (code[7] & 0xFF, code[7] >> 8 & 0xFF) == (ord("h"), ord("g")) and code[8] & 0xFF == kneser_ney.END


# --- op 9 ---------------------------------------------------------------------------------------------------------


def test_range_coder():
    r = np.random.RandomState(1)
    for n in (1, 5, 2047, 2048, 2049, 9000):
        for top in (3, 50257, 65536):
            ids = r.randint(0, top, n)
            assert (range_coder.read_segment(range_coder.write_segment(np.array([7]), np.array([n]), ids))[2] == ids).all()
    skewed = np.minimum(r.geometric(0.3, 40000), 60000)
    data = range_coder.write_segment(np.array([1]), np.array([len(skewed)]), skewed)
    assert (range_coder.read_segment(data)[2] == skewed).all() and len(data) < len(skewed)
    for at in (3, 20, len(data) // 2, len(data) - 1):
        with pytest.raises(range_coder.CorruptError):
            range_coder.read_segment(data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :])


def test_token_files(llm, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    r = random.Random(2)
    rows = [*ODD, *[(i, r.choice(["a  b", "x \n y", "don't", "é à", "a b c", "　 z", "1 2\n3 !!", "<|endoftext|> q"]) + " " + words(r, 30)) for i in range(40)]]
    out = str(tmp_path / "ids")
    got = [tuple(x) for x in range_coder.encode_table(docs(llm, rows), path, out).collect()]
    start, expected = 0, []
    for doc, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == expected
    back = range_coder.read_ids(llm.read.parquet(out))
    assert back.agg(F.sum(F.size("ids"))).first()[0] == start
    assert range_coder.encode_table(docs(llm, rows).limit(0), path, str(tmp_path / "none")).isEmpty()

