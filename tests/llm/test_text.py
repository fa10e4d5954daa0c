"""Media, line dedup, language, chat, n-gram join, mixing."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import chat, encoding, gif, language, line_dedup, mixing, ngram_join, tables

from .helpers import base_rows, deduped, frame, jaccard_components, prose


@settings(max_examples=80, deadline=None)
@given(st.integers(2, 8), st.binary(max_size=3000), st.integers(1, 12))
def test_lzw_round_trip(bits, data, times):
    data = bytes(b & ((1 << bits) - 1) for b in data * times)
    assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, len(data)) == data


def test_lzw_full_tables():
    rng = random.Random(1)
    for data in (bytes(rng.randrange(256) for _ in range(40000)), bytes(60000)):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data
    with pytest.raises(ValueError):
        gif.lzw_decode(b"\xff\xff\xff", 2, 9)


def test_disposal_transparency_palettes_interlace():
    pal = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    own = bytes([9, 9, 9, 8, 8, 8])
    data = gif.build(2, 2, pal, [
        {"samples": bytes([1, 1, 1, 1]), "delay_cs": 5}, {"samples": bytes([2, 3]), "height": 1, "transparent": 3, "disposal": 2},
        {"samples": bytes([3]), "width": 1, "height": 1, "left": 1, "top": 1, "disposal": 3}, {"samples": bytes([0, 1]), "height": 1, "top": 1, "palette": own},
    ])
    w, h, frames = gif.parse(data)
    shown = [c[..., :].copy() for c in gif.composed(w, h, frames)]
    red, green, blue, gone = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert shown[0].tolist() == [[red, red], [red, red]] and shown[1].tolist() == [[green, red], [red, red]]
    assert shown[2].tolist() == [[gone, gone], [red, blue]] and shown[3].tolist() == [[gone, gone], [[9, 9, 9, 255], [8, 8, 8, 255]]]
    assert [f.delay_ms for f in frames] == [50, 0, 0, 0]
    assert gif._rows_in_order(9).tolist() == [0, 8, 4, 2, 6, 1, 3, 5, 7]
    for broken in (data[:20], b"GIF89a", b"", data[:-1], b"x" + data):
        with pytest.raises(ValueError):
            gif.parse(broken)


def test_frames_operator(spark):
    data = gif.build(2, 1, bytes(6) + bytes([255] * 6), [{"samples": bytes([0, 2]), "delay_cs": 7}, {"samples": bytes([2, 2])}])
    rows = gif.frames(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"junk")), (3, None)], "media_id long, media binary")).orderBy("media_id", "frame").collect()
    assert [(r.media_id, r.frame, r.start_ms, r.delay_ms, r.error) for r in rows] == [(1, 0, 0, 70, None), (1, 1, 70, 0, None), (2, None, None, None, "no GIF signature")]
    assert rows[0].red[0] == 1 and rows[0].red[15] == 1 and rows[1].red[15] == 2


def test_payloads(spark):
    got = gif.read_payloads(gif.store_payloads(frame(spark))).collect()
    want = sorted(gif.padded((x[1] or "").encode()) for x in base_rows())
    assert sorted(bytes(r.payload) for r in got) == want and all(len(p) % 576 == 0 and p for p in want)
    assert gif.store_payloads(frame(spark, [])).count() == 0


def test_payload_frames_leave_out_what_they_repeat(spark):
    rng = random.Random(2)
    page = bytes(rng.randrange(32, 127) for _ in range(gif.UNIT * gif.ROWS))
    changed = bytes(b if i % 9 else 65 for i, b in enumerate(page))
    payload = page + changed + bytes([254]) * len(page) + page[: gif.UNIT * 5]
    data = gif.payload_gif(payload)
    assert [f.transparent for f in gif.parse(data)[2]] == [None, 254, None, None] and len(gif.payload_gif(page + changed)) < 1.5 * len(gif.payload_gif(page))
    docs = spark.createDataFrame([(1, len(payload), bytearray(data))], "doc_id long, n_bytes long, media binary")
    row = gif.read_payloads(docs).first()
    assert bytes(row.payload) == payload and [(f.frame, f.start_ms, f.delay_ms) for f in row.frames] == [(0, 0, 100), (1, 100, 100), (2, 200, 100), (3, 300, 100)]
    last = np.frombuffer(page[: gif.UNIT * 5], np.uint8)
    for name, shown in (("red", last), ("green", 255 - last), ("blue", last.astype(int) * 73 % 256)):
        assert row.frames[3][name] == np.bincount(shown >> 4, minlength=16).tolist()


def test_op1_columns(spark, sf):
    docs = {r.doc_id: gif.padded((r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in gif.op1_gif_media(spark, sf).collect():
        p = docs[r.doc_id]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(gif.payload_gif(p)).hexdigest() and r.feature


def test_cross_parsing_counts_longest_matches():
    model = language.Model({"a": "abracadabra alakazam", "b": "hocus pocus fidibus"})

    def count(text, sample):
        s, z, i, n = model.sequence(text).tobytes(), model.sequence(sample).tobytes(), 0, 0
        while i < len(s):
            j = i
            while j < len(s) and s[i : j + 1] in z:
                j += 1
            i, n = max(j, i + 1), n + 1
        return n

    texts = ["abra cadabra", "pocus", "ABRA! 12 你", "q", "zam hocus", "x" * 999]
    got = model.phrases([model.sequence(t) for t in texts])
    assert got.tolist() == [[count(t, "abracadabra alakazam"), count(t, "hocus pocus fidibus")] for t in texts]


def test_language_cases(spark):
    docs = tables.pick(frame(spark), "doc_id", "text", "lang")
    out = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs, {"en": "the dog", "xx": "qq ww"}, ["doc_id"]).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (15, "und", 0.0)} <= out and all(0 <= s <= 1 for _, _, s in out)
    assert {r.lang_pred for r in language.identify(docs, {}, ["doc_id"]).collect()} == {"und"}
    assert language.bounded_sample(tables.pick(frame(spark, []), "text", "lang")) == {}


def test_language_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    page = "boiler plate " * 40
    some = spark.range(100_000).selectExpr(f"case when id % 100 = 0 then concat(repeat('word', 3), cast(id as string)) else '{page}' end as text", "case when id % 7 = 0 then 'xx' else 'en' end as lang")
    dirty = spark.range(5).selectExpr("'q' as text", "concat('dirty', id) as lang")
    got = language.bounded_sample(some.union(dirty), 2000)
    assert sorted(got) == ["en", "xx"] and all(v.count(page) <= 1 for v in got.values())
    assert all(900 < len(v.replace("\n", "")) <= 2000 for v in got.values())


def test_held_out_accuracy(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in language.op3_language_id(spark, sf).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.95


def lines(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")


def test_line_dedup_templates(spark):
    boiler = "Page 12 of 40 printed by the old press on 2020-01-02"
    other = "Page 3 of 9 printed by the old press on 2021-11-30"
    named = "This text was kindly sent to us by {} from the far north of here"
    docs = lines(spark, [
        (1, f"own first line that nobody else has\n{boiler}"), (2, f"{other}\nsecond text with words of its own"), (3, named.format("Anna")), (4, "Short one.\n" + named.format("Bob")),
        (5, "Short one.\n\n" + named.format("Carl")), (6, None), (7, ""), (None, "a line of words in no document\na line of words in no document"),
    ])
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == (f"own first line that nobody else has\n{boiler}", 2, 0) and got[2] == ("second text with words of its own", 2, 1)
    assert got[3][2] == 0 and got[4] == ("Short one.", 2, 1) and got[5] == ("Short one.\n", 3, 1)
    assert got[6] == (None, 0, 0) and got[7] == ("", 1, 0) and got[None][2] == 0


def test_line_dedup_counts_short_lines_verbatim(spark, tmp_path):
    docs = lines(spark, [
        (1, "All rights reserved.\n12 13 14 15 16\n你好世界\nchapter 1\n1"), (2, "All rights reserved.\n \n12 13 14 15 16\nchapter 2\n2"), (3, "All rights  reserved.\n你好世界\n12 13 14 15 17\nchapter 1\nchapter 1"),
    ])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()}
    # what differs in digits or blanks is another line; the first by doc_id stays
    assert got[1][1] == 0 and got[2] == (" \nchapter 2\n2", 2) and got[3] == ("All rights  reserved.\n12 13 14 15 17", 3)
    stage = corpus_pipeline.dedup_lines(spark, docs.selectExpr("doc_id", "text", "length(text) as n_chars"), "")
    assert {r.doc_id: r.text for r in stage.collect()} == {i: t for i, (t, _) in got.items()}


@pytest.mark.parametrize("more", [0, 2])
def test_line_dedup_several_templates_of_a_leaf(spark, more):
    sent, printed = "This text was kindly sent to us by {} from the far north", "This text was printed for the schools of {} and other good towns"
    texts = [sent.format(f"name{c}") for c in "abc" + "xy"[:more]] + [printed.format(f"town{c}") for c in "abc"]
    others = ["This text was " + " ".join(f"{a}{b}" for b in "abcdefghij") for a in "pqr"]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(lines(spark, enumerate(texts + others)), short=True).collect()}
    first = {0, 3 + more, *range(len(texts), len(texts + others))}
    assert {i for i, t in got.items() if t} == first


def test_line_dedup_keeps_indented_lines_that_occur_once(spark):
    texts = ["def f():\n    alpha\n        three four", "def g():\n    beta\n        five six", "class h:\n    gamma\n    return 1", "x\n    return 2\n  \n    \n \t "]
    got = line_dedup.dedup_lines(lines(spark, enumerate(texts)), short=True)
    assert {r.doc_id: r.text for r in got.collect()} == dict(enumerate(texts))
    same = "the  old press of the\tfar north printed this"
    texts = [same, "    " + same.replace("\t", " "), " ".join(same.split()) + "  "]
    assert [r.text for r in line_dedup.dedup_lines(lines(spark, enumerate(texts))).orderBy("doc_id").collect()] == [same, "", ""]


def random_lines(seed, n):
    rng = random.Random(seed)
    word = lambda k: rng.choice(["old", "press", "far", "north", "towns", "42", "x7", "kind", "日本"][:k])
    shapes = [
        lambda: f"This text was sent to us by {word(9)}{rng.randrange(9)} from the {word(5)} {word(5)}", lambda: f"Posted on the {word(6)} of member {word(9)} for {word(4)} sport",
        lambda: " ".join(word(9) for _ in range(rng.randrange(1, 9))), lambda: f"page {rng.randrange(4)}\tof 9", lambda: rng.choice(["", "  ", "All rights reserved.", "同一个句子没有空格"]),
        lambda: "Posted on the " + " ".join(f"{word(5)}{word(5)}" for _ in range(6)),
    ]
    blanks = lambda line: rng.choice(["", "", "    ", "\t", "        "]) + (line.replace(" ", rng.choice(["  ", "\t \r"])) if rng.random() < 0.2 else line) + rng.choice(["", "", "  "])
    rows = [(i, "\n".join(blanks(rng.choice(shapes)()) for _ in range(rng.randrange(9)))) for i in range(n)]
    return rows + [(None, "All rights reserved.\nold press of the far north"), (n + 1, None), *rows[:3]]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [500, 0])
def test_line_dedup_equals_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(line_dedup, "HOT_DOCS", hot)
    rows = random_lines(seed, 120)
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(lines(spark, rows), short=True).select("doc_id", "text").collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    assert sorted(got, key=order) == sorted(deduped(rows), key=order)
    assert sum(a != b for a, b in zip(sorted(rows, key=order), sorted(got, key=order))) > 50


def test_line_dedup_of_many_lines(spark):
    text = "\n".join(f"line {'abcdefghij'[i % 10]}{i}" for i in range(60_000))
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(lines(spark, [(1, text), (2, text + "\nmore of it")]), short=True).collect()}
    assert got == {1: (text, 0), 2: ("more of it", 60_000)}


def test_line_dedup_keeps_columns_and_repeats(spark):
    docs = frame(spark, [(1, "words of a line that two have in common", "en", "s", 1, "c", "c", 1, "k", "x")] * 2 + [(2, "words of a line that two have in common", "en", "s", 1, "c", "c", 1, "k", "x")])
    got = line_dedup.dedup_lines(docs)
    assert got.columns[:10] == docs.columns and sorted((r[0], r[1]) for r in got.collect()) == [(1, "words of a line that two have in common")] * 2 + [(2, "")]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0 and line_dedup.dedup_lines(frame(spark)).count() == len(base_rows())


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\|im_end|>", "<<s>", "[[/INST]", "<|im_sep|>", "<s", "a\nb", "", "<<SYS>>x<</SYS>>", "</s</s>"])
def test_escape(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert row.u == text
    for mark in ("</s>", "<s>", "[INST]", "[/INST]", "<|"):
        assert mark not in row.e


def test_chat_parts(spark):
    part = "struct<kind:string,text:string,ref:string,units:bigint>"
    rows = [
        (1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "a.png", 300000), None, ("audio", None, "b.wav", 100)]), (1, 1, "assistant", [("text", "fine", None, None)]),
        (1, 1, "assistant", [("document", None, "c.pdf", 9), ("video", None, "d", 1)]), (None, None, None, None), (2, 5, "assistant", []),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    got = {r.conv_id: r for r in chat.parse(chat.format_conversations(turns)).collect()}
    one = got[1]
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [("image", "a.png", 425), ("audio", "b.wav", 3), ("document", "c.pdf", 3), ("video", "d", 0)] and one.attachment_tokens == 431
    assert [(p.role, p.content, p.loss) for p in one.parsed] == [("user", "see <|image|><|image|><|audio|>", False), ("assistant", "<|document|><|attachment|>", True), ("assistant", "fine", True)]
    assert sum(m.chars for m in one.mask) == len(one.formatted)
    assert [(p.role, p.content, p.loss) for p in got[None].parsed] == [("", "", False)] and got[2].parsed[0].loss
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_op6_columns(spark, sf):
    convs: dict = {-1: [("user", chat.PROBE), ("assistant", chat.PROBE)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = chat.op6_chat_format(spark, sf).collect()
    assert len(got) == len(convs)
    for r in got:
        t = convs[r.conv_id]
        learnt = "".join(x for role, x in t if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(t), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()


def key(rows):
    return sorted(((i is None, i or 0, n, c is None, c or 0) for i, n, c in rows))


@pytest.mark.parametrize("pairs", [2_000, 0])
def test_ngram_join(spark, monkeypatch, pairs):
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    base = prose(50, 120).split(" ")
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in base_rows()]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"edit{i}x{rng.randrange(99)}"
        rows.append((100 + i, " ".join(words)))
    docs = frame(spark, [(i, t, "en", "s", 1, "c", "c", 1, "k", "x") for i, t in rows])
    got = ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert key(got) == key(jaccard_components(rows))


def test_ngram_join_counts_a_repeated_row_once(spark):
    a, b, c = prose(60, 300).split(" "), prose(61, 300).split(" "), prose(62, 300).split(" ")
    mixed = " ".join(a[:150] + b[:150])  # a third of the n-grams of both are shared: Jaccard 0.33
    rows = [(1, " ".join(a)), (1, " ".join(a)), (1, " ".join(a)), (2, mixed), (None, " ".join(c)), (None, " ".join(c)), (3, " ".join(c[:160] + b[150:])), (4, " ".join(a[:299]) + " end")]
    docs = frame(spark, [(i, t, "en", "s", 1, "c", "c", 1, "k", "x") for i, t in rows])
    got = ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert key(got) == key(jaccard_components(rows))
    sets = ngram_join.token_sets(docs, ngram_join.sketch(docs))
    assert sets.count() == sets.select("class").distinct().count() > 0


def test_ngram_join_of_nothing(spark):
    assert ngram_join.join(frame(spark, [])).count() == 0


def test_rake_matches_marginals():
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, n, 200) for n in (5, 4, 3)]
    targets = [rng.dirichlet(np.ones(n)) for n in (5, 4, 3)]
    w = mixing.rake(rng.random(200) + 0.1, codes, targets, 500, 1e-12)
    for c, t in zip(codes, targets):
        assert np.allclose(np.bincount(c, w, len(t)), t, atol=1e-6)


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cells = mixing.described(docs).groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    order = lambda df: sorted((r.source, r.lang, r.topic, round(r.w, 6)) for r in df.collect())
    assert order(mixing.cell_weights(cells, rounds=8)) == order(mixing.cell_weights(cells, rounds=8, driver_cells=0))
    rows = mixing.probabilities(docs).collect()
    assert len(rows) == docs.count() and max(r.probability for r in rows) == 1.0
    for r in rows:
        assert 0 <= r.probability <= 1
    model = encoding.encoder(encoding.default_path()).model
    sizes = {r.doc_id: len(model.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert all(r.n_tokens == sizes[r.doc_id] for r in rows)
    assert {r.doc_id for r in mixing.mix(docs).collect()} == {r.doc_id for r in rows if r.selected}


@pytest.mark.parametrize("driver_cells", [200_000, 0])
def test_mixing_scale_follows_from_the_mass(spark, monkeypatch, driver_cells):
    monkeypatch.setattr(mixing.cell_weights, "__defaults__", (None, 8, mixing.TOLERANCE, driver_cells))
    rows = [(i, prose(i, 300), "en" if i % 5 else "de", "big" if i % 4 else "small", 1, "c", "c", 1, "k", "x") for i in range(200)]
    kept = []
    for more in ([], [(999, prose(999, 10), "en", "stray", 1, "c", "c", 1, "k", "x")]):
        out = mixing.probabilities(frame(spark, rows + more)).collect()
        expected = [r.n_tokens * r.probability for r in out]
        kept.append(sum(expected) / sum(r.n_tokens for r in out))
        raked = [r.n_tokens * r.weight for r in out]
        for d in mixing.DIMENSIONS:
            share = lambda x, c: sum(v for v, r in zip(x, out) if r[d] == c) / sum(x)
            assert sum(abs(share(expected, c) - share(raked, c)) for c in {r[d] for r in out}) / 2 <= mixing.MARGIN + 1e-6
    assert kept[1] > 0.95 * kept[0] > 0.5


def test_topics_are_clusters_within_languages(spark):
    themes = ["sea ship sail harbour wave anchor tide", "bread oven flour yeast dough baker loaf", "judge court law trial verdict jury appeal"]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(themes[i % 3].split()) for _ in range(80)) + (" the of and" if i % 2 else " der die und") * 20, "en" if i % 2 else "de", "s", 1, "c", "c", 1, "k", "x") for i in range(120)]
    told = {r.doc_id: r.topic for r in mixing.described(frame(spark, rows)).collect()}
    again = {r.doc_id: r.topic for r in mixing.described(frame(spark, rows[::-1]).repartition(7)).collect()}
    assert told == again
    # a topic holds one theme, in both languages
    by_topic: dict = {}
    for i, t in told.items():
        by_topic.setdefault(t, []).append(i)
    assert 3 <= len(by_topic) <= mixing.TOPICS and all(len({i % 3 for i in m}) == 1 for m in by_topic.values())
    assert {len({i % 2 for i in m}) for m in by_topic.values()} >= {2}


def test_token_weights_of_scripts_without_blanks(spark):
    rows = [(1, "这是没有空格的中文句子" * 30, "zh", "s", 1, "c", "c", 1, "k", "x"), (2, "a few words", "en", "s", 1, "c", "c", 1, "k", "x")]
    weights = {r.doc_id: r.n_tokens for r in mixing.described(frame(spark, rows)).collect()}
    assert weights[1] > 100 and weights[2] == 3


def test_rake_says_if_it_misses():
    codes = [np.array([0, 1]), np.array([0, 1])]
    with pytest.warns(UserWarning, match="raking stopped"):
        mixing.rake(np.ones(2), codes, [np.array([0.5, 0.5]), np.array([0.9, 0.1])], 20)


def test_mixing_cases(spark):
    out = mixing.probabilities(frame(spark)).collect()
    assert len(out) == len(base_rows()) and {r.probability for r in out if r.n_tokens == 0} == {1.0}
    mixed = mixing.mix(frame(spark))
    assert mixed.columns == frame(spark).columns and mixed.count() == sum(r.selected for r in out)
    assert mixing.probabilities(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [])).count() == 0


def test_mixing_sends_texts_once_in_small_batches(spark, monkeypatch):
    name, sent = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    plain, write = mixing.with_tokens, tables.store

    def with_tokens(rows, text, keep, **more):
        sent.append(text in keep)
        return plain(rows, text, keep, **more)

    def store(df, table, **more):
        if table == "tokens":
            sent.append(int(spark.conf.get(name)))
        return write(df, table, **more)

    monkeypatch.setattr(mixing, "with_tokens", with_tokens)
    monkeypatch.setattr(tables, "store", store)
    before = spark.conf.get(name)
    assert 0 < mixing.mix(frame(spark)).count() <= len(base_rows())
    assert sent == [True, mixing.FEW_ROWS] and spark.conf.get(name) == before
    # a text that is no string is cast, and kept as it was
    sent.clear()
    out = mixing.mix(frame(spark).drop("Text").withColumn("text", F.col("doc_id")))
    assert sent[0] is False and dict(out.dtypes)["text"] == "bigint"


def test_encoder_that_keeps_few_chunks_gives_the_same_ids():
    import pyarrow as pa

    few, all_ = encoding.Encoder(encoding.default_path(), 20, True), encoding.Encoder(encoding.default_path())
    for seed in range(12):
        texts = pa.array([prose(seed % 5, 40), "so, it ends. so, it ends, here.", None, "x" * 60 + ", " + prose(seed, 9)])
        assert [x.tolist() for x in few.encode(texts)] == [x.tolist() for x in all_.encode(texts)]
        assert len(few._kept) <= 20 + 100 and len(few._older) <= 20 + 100
