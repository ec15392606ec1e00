"""The operators of gridskein.llm against brute force, with nulls, empty and repeated rows, and clashing names."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest

from gridskein.llm import _gru, chat, decontamination, html_extract, language_id, lm_scoring, media, packing, queries, simhash_dedup, suffix_dedup, warc
from gridskein.operators.components import connected_components

from ..oracle import DATA, compare, connect

DOCS = "doc_id long, text string, kept string, spans int"


def _docs(spark, texts):
    return spark.createDataFrame([(None if k == 3 else k, t, "x", k) for k, t in enumerate(texts)], DOCS)


# 1 packing


def test_encoder_equals_tokenizers():
    rng = random.Random(0)
    own = packing.Encoder(queries.tokenizer_path(), queries.tokenizer_path("byte_bpe_50k.tiktoken"))
    alphabets = "abcéÉñ '’_-.,!\n\t 0129²×÷µªAB \x1c\xa0", "abcéÉñ '_-.,!\n\t 0129AB\r`[]{}~^"
    texts = ["", "<|endoftext|> hi's it''s  x\n\n\n y\t z  "] + ["".join(rng.choice(a) for _ in range(40)) for a in alphabets for _ in range(1000)]
    assert own.encode(texts) == own._direct(texts)


def test_packing(spark):
    texts = ["a b", None, "", "q" * 5, "word " * 90, "x " * 33, "a b"] * 3
    docs = _docs(spark, texts)
    rows = packing.pack_documents(docs, queries.tokenizer_path(), capacity=32, pool=10).toPandas()
    encoder = packing.Encoder(queries.tokenizer_path())
    want = collections.Counter()
    for k, text in enumerate(texts):
        ids = encoder.encode([text or ""])[0] + b"\0" * 4
        n = len(ids) // 4
        cuts = [0, n] if n <= 32 else [0, *range(n % 32 or 32, n + 1, 32)]
        for j, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[(None if k == 3 else k, j, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))] += 1
    got = collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert got == want
    for _, bin_ in rows.sort_values("offset").groupby("sequence_id"):
        assert bin_["offset"].tolist() == [0, *np.cumsum(bin_["length"])[:-1]] and bin_["length"].sum() <= 32
    assert rows["sequence_id"].nunique() <= 1.2 * rows["length"].sum() / 32 + 3
    assert packing.pack_documents(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_sum_of_squares_places_where_the_sum_is_least():
    rng, capacity = np.random.default_rng(2), 12
    lengths = rng.integers(1, capacity + 1, 60)
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    used: dict[int, int] = {}
    squares = lambda u: sum(n * n for g, n in collections.Counter(capacity - v for v in u.values()).items() if g)
    for size, own, offset in zip(lengths, bins, offsets, strict=True):
        options = [squares({**used, b: u + size}) for b, u in used.items() if u + size <= capacity] + [squares({**used, -1: size})]
        assert used.get(own, 0) == offset
        used[own] = offset + size
        assert used[own] <= capacity and squares(used) == min(options)


# 2 suffix-array dedup


def _removed(texts, length):
    blobs, seen = [(t or "").encode() for t in texts], collections.Counter()
    for b in blobs:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(c for c, g in zip(b, gone, strict=True) if not g), len(bytes(gone).replace(b"\0", b" ").split())))
    return out


@pytest.mark.parametrize("length", [64, 100, 70, 131])
def test_suffix_dedup(spark, length):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [word(rng.randint(60, 300)) for _ in range(6)]
    texts = [None, "", "x" * 500, "ab" * 300, word(50)] + [word(rng.randint(0, 200)) + rng.choice(shared)[rng.randint(0, 30) :] + word(90) + rng.choice(shared) for _ in range(40)]
    texts += texts[5:8]
    rows = {r.spans: r for r in suffix_dedup.suffix_dedup(_docs(spark, texts), length=length).collect()}
    assert [(bytes(rows[k].kept), len(rows[k].removed)) for k in range(len(texts))] == _removed(texts, length)


@pytest.mark.parametrize(("report", "length"), [(64, 64), (64, 90), (70, 150)])
def test_suffix_dedup_reports_shorter_repeats(spark, report, length):
    """What is removed doesn't change, and what is reported is what the shorter length would remove."""
    rng = random.Random(report + length)
    word = lambda n: "".join(rng.choice("abcdeé\0 ") for _ in range(n))
    shared = [word(n) for n in (60, 75, 120, 200, 300)]
    texts = [None, "", "ab" * 200] + [word(rng.randint(0, 90)) + rng.choice(shared)[rng.randint(0, 20) :] + word(30) + rng.choice(shared) for _ in range(60)]
    texts += texts[3:6]
    rows = {r.spans: r for r in suffix_dedup.suffix_dedup(_docs(spark, texts), length=length, report=report).collect()}
    assert [(bytes(rows[k].kept), len(rows[k].removed)) for k in range(len(texts))] == _removed(texts, length)
    for k, (kept, n) in enumerate(_removed(texts, report)):
        assert len(rows[k].repeated) == n and sum(r.stop - r.start for r in rows[k].repeated) == len((texts[k] or "").encode()) - len(kept)


def test_suffix_dedup_one_bucket(spark):
    """Contexts that share one q-gram, or all but a byte, in one bucket."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = word(45), word(220)
    texts = [word(rng.randint(80, 120)) + line + word(rng.randint(80, 120)) for _ in range(150)]
    for _ in range(150):
        at = rng.randrange(220)
        texts.append(word(30) + passage[:at] + rng.choice("XYZ") + passage[at + 1 :] + word(30))
    rows = {r.spans: r for r in suffix_dedup.suffix_dedup(_docs(spark, texts), length=100).collect()}
    assert [(bytes(rows[k].kept), len(rows[k].removed)) for k in range(len(texts))] == _removed(texts, 100)


def test_suffix_dedup_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdef") for _ in range(900))
    texts = ["".join(rng.choice("abcdef") for _ in range(3000)) + shared + "".join(rng.choice("abcdef") for _ in range(n)) + shared for n in (700, 2100)]
    views = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    whole = suffix_dedup._text_anchors(views, 400)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    parts = suffix_dedup._text_anchors(views, 400)
    flat = lambda found: sorted(zip(*(np.concatenate(c).tolist() for c in zip(*found, strict=True)), strict=True))
    assert flat(whole) == flat(parts)


def test_suffix_dedup_empty_table(spark):
    assert suffix_dedup.suffix_dedup(_docs(spark, ["a"]).limit(0)).count() == 0


# 3 HTML extraction


def test_page_blocks():
    html = (
        "<title>t</title><header><h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav><p>Hi &amp; <b>bo</b>ld<br>x<p>two&nbsp; y</p><div class='cookie-notice'>We</div>"
        "<aside>s</aside><form>f<input><p>q</form><script>var a='</p>';</script><footer>f</footer>"
    )
    assert [t for t, z in html_extract.page_blocks(html) if z] == ["Hi & bold x", "two y"]
    html = "<p>out</p><article><header><h1>T</h1></header><p>a<span class=ad>zz</span> b<!-- <p> -->c<div id='comments'><p>cc</p></div><p>d</article>tail"
    assert [t for t, z in html_extract.page_blocks(html) if z] == ["T", "a", "bc", "d"]
    assert html_extract.page_blocks("") == [] and html_extract.page_blocks("<p>x <b>y") == [("x y", 1)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_host_boilerplate(spark, limit):
    pages = [(k, f"http://h/{k}", f"<div>page {k} has some words of its own here</div><div>We are a company that sells things to you all</div>", "m") for k in range(4)]
    pages += [(9, None, None, "m"), (None, "x", "<p>a", "m"), (7, "http://h/7", pages[0][2], "m"), (7, "http://h/7", pages[0][2], "m")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, main_text string")
    rows = html_extract.extract_main_text(frame, broadcast_rows=limit).collect()
    assert sorted(r.main_text for r in rows) == sorted([f"page {k} has some words of its own here" for k in (0, 1, 2, 3, 0, 0)] + ["", "a"])
    assert html_extract.extract_main_text(frame.limit(0)).count() == 0


def _main_texts(pages, words=8, inside=20, least=3):
    """Texts of (id, url, html) by brute force: every window of each page's stream, counted by host."""
    blocks, hosts, streams = {}, {}, collections.defaultdict(dict)
    for k, url, page in pages:
        blocks[k], hosts[k] = html_extract.page_blocks(page or ""), html_extract.host_of(url)
        streams[hosts[k]][repr(blocks[k])] = k

    def windows(k, article):
        at = 0
        for own, part in itertools.groupby(blocks[k], lambda b: b[1] == 2):
            tokens = [(w, z) for t, z in part for w in t.split(" ")]
            if own == article:
                for i in range(len(tokens) - words + 1):
                    yield at + i, tuple(w for w, _ in tokens[i : i + words]), max(z for _, z in tokens[i : i + words])
            at += len(tokens)

    out = {}
    for k in blocks:
        pages_of = streams[hosts[k]].values()
        seen, outside = collections.defaultdict(set), collections.defaultdict(set)
        for other in pages_of:
            for _, gram, zone in windows(other, False):
                seen[gram].add(other)
                if zone == 0:
                    outside[gram].add(other)
        gone = {i + j for i, gram, zone in windows(k, False) if zone == 1 and len(seen[gram]) >= least for j in range(words)}
        gone |= {i + j for i, gram, _ in windows(k, True) if len(seen[gram]) >= least and len(outside[gram]) >= max(least, len(pages_of) / 2) for j in range(words)}
        texts, at = [], 0
        for text, zone in blocks[k]:
            tokens = text.split(" ")
            marks = [at + i in gone for i in range(len(tokens))]
            at += len(tokens)
            if zone and not all(marks):
                spans = [list(g) for _, g in itertools.groupby(range(len(tokens)), lambda i: marks[i])]
                texts.append(" ".join(tokens[i] for span in spans if not marks[span[0]] or len(span) < inside for i in span))
        out[k] = "\n".join(texts)
    return out


def test_host_suffix_array_by_brute_force(spark):
    """Boilerplate inside blocks and inside articles, without telling names; hosts apart; copies count once."""
    rng = random.Random(12)
    word = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    notice, motto, quote = word(25), word(9), word(30)
    pages = []
    for k in range(120):
        host, own = rng.choice(["a.org", "b.org", "www.c.org"]), word(rng.randint(5, 40))
        if rng.random() < 0.5:
            body = f"<p>{own} {notice} {word(4)}</p>" + (f"<p>{motto}</p>" if rng.random() < 0.7 else "") + f"<p>{word(30)}</p>"
        else:
            body = f"<footer>{notice}</footer><article><p>{own}</p><p>{notice if rng.random() < 0.6 else quote}</p><p>{word(3)} {notice}</p></article><footer>{motto} {notice}</footer>"
        pages.append((k, f"http://{host}/{k}", body))
    pages += [(200 + k, "http://d.org/x", pages[0][2]) for k in range(5)] + [(300, None, None), (301, "http://a.org", "")]
    want = _main_texts(pages)
    for parts in (3, 1):
        frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts)
        assert {r.page_id: r.main_text for r in html_extract.extract_main_text(frame).collect()} == want
    plain = {k: "\n".join(t for t, z in html_extract.page_blocks(h or "") if z) for k, _, h in pages}
    changed = [k for k in want if want[k] != plain[k]]
    assert any("<article>" in pages[k][2] for k in changed if k < 120) and any("<article>" not in pages[k][2] for k in changed if k < 120)
    assert want[200] == plain[200]


def test_articles_of_pages(spark):
    import pandas as pd

    found = queries.op3_html_extraction(spark, f"{DATA}/sf0.001").toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{DATA}/sf0.001/pages.parquet").set_index("page_id")
    import html
    import re

    for k, page in pages["html"].items():
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body))
        assert found.loc[k, "text"] == "\n".join(b for b in blocks if b)


# 4 media


def test_find_media():
    png, packed = media.encode_png(b"\0" * 576), gzip.compress(b"hello" * 100)
    wav = b"RIFF" + struct.pack("<I", 40) + b"WAVEfmt " + struct.pack("<I", 16) + b"\0" * 16 + b"data" + struct.pack("<I", 4) + b"\1" * 4
    bmp = b"BM" + struct.pack("<IIIIiiHH", 62, 0, 54, 40, 1, 2, 1, 24) + b"\0" * 32
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2L\1\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2zz\xff\0\xff\xd9"
    ogg = b"OggS\0\4" + b"\0" * 20 + b"\1\3abc"
    parts = [("image/png", png), ("application/gzip", packed), ("audio/wav", wav), ("image/bmp", bmp), ("image/gif", gif), ("image/jpeg", jpeg), ("audio/ogg", ogg)]
    blob, want = b"BM junk", []
    for kind, part in parts:
        want.append((kind, len(blob), len(part)))
        blob += part + b"\xff\xd8\xff RIFF"
    assert media.find_media(blob) == want
    for kind, part in parts:
        assert media.find_media(part)[0] == (kind, 0, len(part)) and media.find_media(part[:-1]) == []
    assert media.find_media(b"") == []


def test_media_round_trip(spark):
    texts = [None, "", "é" * 400, "x" * 576, "x" * 577, "plain"]
    stored = media.store_texts(_docs(spark, texts))
    rows = {r.spans: r for r in media.media_features(media.sniff_media(stored).drop("carved")).collect()}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        b += b"\xff" * (-len(b) % 576 or (0 if b else 576))
        assert (rows[k].payload_bytes, rows[k].payload_sha256, rows[k].tail_crc32, rows[k].sniffed_type) == (len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-32:]), "image/png")
    assert rows[0].media_sha256 == rows[1].media_sha256


def _described(text):
    """Columns of op4 for a text, one step after the other in plain Python."""
    b = (text or "").encode()
    payload = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
    place, form = divmod(zlib.crc32(payload), 3)
    rows = len(payload) // 576
    if form == 0:
        raw = b"".join(b"\0" + payload[k : k + 576] for k in range(0, len(payload), 576))
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        stored = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 576, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")
        what = f"image/png 576x{rows} grey8"
    elif form == 1:
        stored = b"BM" + struct.pack("<IHHI", 1078 + len(payload), 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, 576, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0)
        stored += b"".join(bytes((k, k, k, 0)) for k in range(256)) + payload
        what = f"image/bmp 576x{rows} grey8"
    else:
        stored = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        what = "audio/wav 8000 Hz mono8"
    shares = [n / len(payload) for n in collections.Counter(payload).values()]
    feature = f"{what} mean={sum(payload) / len(payload):.4f} entropy={-sum(s * math.log2(s) for s in shares) + 0:.4f}"
    inside = place % 4 == 0
    return len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, what.split()[0], form == 0 and not inside, len(media.ENVELOPE) * inside


def test_media_query_by_plain_steps(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (None, "BM" * 900), (None, "BM" * 900), (-3, "RIFF\x1f \ufeffGIF89a" * 50)], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(tuple(r) for r in queries.op4_media_sniffing(spark, str(tmp_path)).collect())
    texts = docs.unionByName(more).collect()
    assert got == collections.Counter((r.doc_id, *_described(r.text)) for r in texts)
    assert len({k[8] for k in got}) == 3 and {k[9] for k in got} == {True, False} and len({k[10] for k in got}) == 2


def test_media_odd_tables(spark):
    """Empty tables, clashing names, foreign and broken media."""
    frame = spark.createDataFrame([("a", bytearray(b"\x89PNG\r\n\x1a\n"), "x", "y"), ("b", None, "x", "y"), ("c", bytearray(gzip.compress(b"z")), "x", "y")], "text string, media binary, feature string, type_ok string")
    found = {r.text: r for r in media.media_features(frame).collect()}
    assert found["a"].media_bytes == 8 and found["a"].payload_bytes is None and found["b"].media_sha256 is None and found["c"].feature is None
    assert found["a"].type_ok == "y"
    assert {r.type_ok for r in media.sniff_media(frame).collect()} == {None}
    stored = media.store_texts(frame, mixed=True)
    assert stored.columns == ["text", "feature", "type_ok", "media", "declared_type"] and stored.count() == 3
    empty = frame.limit(0)
    assert media.media_features(media.sniff_media(media.store_texts(empty))).count() == 0
    inner = media.encode_png(b"\2" * 576)
    outer = b"RIFF" + struct.pack("<I", 12 + len(inner)) + b"WAVEdata" + struct.pack("<I", len(inner)) + inner
    parts = media.sniff_media(spark.createDataFrame([(bytearray(b"--" + outer),)], "media binary")).first().carved
    assert [(p.type, p.start, p.length, p.content is None) for p in parts] == [("audio/wav", 2, len(outer), False), ("image/png", 22, len(inner), True)]


def test_declared_types(spark):
    png = media.encode_png(b"\1" * 576)
    frame = spark.createDataFrame([(None, "a"), (bytearray(png), "image/jpeg"), (bytearray(b"zz" + png), None), (bytearray(), "x")], "media binary, declared string")
    rows = media.sniff_media(frame, "media", "declared").collect()
    assert [(r.sniffed_type, r.type_ok, len(r.carved)) for r in rows] == [(None, False, 0), ("image/png", False, 0), ("application/octet-stream", False, 1), ("application/octet-stream", False, 0)]
    assert bytes(rows[2].carved[0].content) == png


# 5 chat


@pytest.mark.parametrize("block", [4096, 3])
def test_quotation_linking_equals_sql(spark, monkeypatch, block):
    import pandas as pd

    monkeypatch.setattr(chat, "BLOCK", block)
    rng, rows = random.Random(3), []
    for conversation in range(12):
        history = []
        for turn in range(12):
            own = [rng.choice(["Hello  There", "what?", "yes", f"line {rng.randint(0, 40)}", "", "  x "]) for _ in range(3)]
            quotes = [rng.choice([f"> {x}", f">{x}", f">> {x.upper()}"]) for x in rng.choice(history).split("\n")] if history and rng.random() < 0.7 else []
            history.append("\n".join(quotes + own))
            rows.append((conversation, turn, "user", history[-1] if rng.random() < 0.97 else None))
    con = connect("/nowhere")
    con.register("t", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    con.execute("CREATE VIEW conversations AS SELECT * FROM t")
    sql = queries.ORACLE_SQL["op5_quotation_linking"]
    first = "WHERE level = 1 AND line <> '' GROUP"
    for nested, own in ((True, sql), (False, sql.replace("WHERE level > 0 AND line <> '' GROUP", first))):
        assert nested or first in own
        found = chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), nested=nested)
        frame = found.select("conv_id", "thread", "turn", "role", "reply_to", "n_quoted", "n_linked", "text").toPandas()
        assert frame["reply_to"].notna().sum() > 20
        assert compare(con, frame, own) == ""


def test_quotation_linking_edges(spark):
    rows = [(None, 1, "> a\nb", 0), (1, None, None, 0), (1, 2, "a", 0), (1, 3, "> A", 0), (1, 3, "> A", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string, thread int")
    found = [(r.conv_id, r.turn, r.text, r.reply_to, r.thread) for r in chat.link_quotations(frame).collect()]
    assert collections.Counter(found) == collections.Counter([(None, 1, "b", None, None), (1, None, None, None, None), (1, 2, "a", None, 2), (1, 3, "", 2, 2), (1, 3, "", 2, 2)])
    assert chat.link_quotations(frame.limit(0)).count() == 0


def test_quotation_linking_is_native(spark):
    plan = chat.link_quotations(spark.createDataFrame([(1, 1, "> a")], "conv_id long, turn long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# 6 language model


def test_gradients():
    rng = np.random.default_rng(0)
    p = _gru.initial(rng.integers(0, 100, _gru.VOCABULARY).astype(float), rng.integers(0, 100, _gru.RARE).astype(float))
    p = {k: v + rng.normal(size=v.shape) * 0.2 for k, v in p.items()}
    docs = [rng.integers(0, _gru.VOCABULARY + _gru.RARE, n) for n in (7, 5, 9, 3)]
    ids, sizes = np.concatenate(docs), np.array([7, 5, 9, 3])

    class Kept(_gru.Trainer):
        def _adam(self, grads, n):
            self.grads = _gru.unflat(grads)

    trainer = Kept(p, lanes=1, window=24)
    trainer.train(docs)
    loss = lambda q: -_gru.score(q, ids, sizes).sum()
    for name in _gru.SHAPES:
        big = np.unravel_index(np.abs(trainer.grads[name]).argmax(), p[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][big] += 1e-4
        down[name][big] -= 1e-4
        # Scores keep their state in single precision.
        assert np.isclose((loss(up) - loss(down)) / 2e-4, trainer.grads[name][big], rtol=0.05, atol=0.02)


def test_class_factored_softmax_sums_to_one():
    rng = np.random.default_rng(1)
    p = {k: rng.normal(size=s) for k, s in _gru.SHAPES.items()}
    every = np.arange(_gru.VOCABULARY + _gru.RARE)
    found = _gru.log_probabilities(p, np.tile(rng.normal(size=_gru.UNITS), (len(every), 1)), every)
    assert np.isclose(np.exp(found).sum(), 1)


def test_scores_by_plain_loops():
    """The recurrent score, one token and one unit at a time."""
    rng = np.random.default_rng(3)
    p = {k: rng.normal(size=s) * 0.4 for k, s in _gru.SHAPES.items()}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    docs = [rng.integers(0, _gru.VOCABULARY + _gru.RARE, n) for n in (9, 1, 40, 3)]
    u, sigmoid = _gru.UNITS, lambda v: 1 / (1 + math.exp(-v))
    for doc, got in zip(docs, _gru.score(p, np.concatenate(docs), np.array([len(d) for d in docs])), strict=True):
        h, total = [0.0] * u, 0.0
        for word in doc.tolist():
            cls = word // _gru.CLASS_SIZE if word < _gru.VOCABULARY else word - _gru.VOCABULARY + _gru.CLASSES
            logits = [sum(h[i] * float(p["wc"][i, c]) for i in range(u)) + float(p["wc"][u, c]) for c in range(_gru.CLASSES + _gru.RARE)]
            total += logits[cls] - math.log(sum(map(math.exp, logits)))
            if word < _gru.VOCABULARY:
                inside = range(cls * _gru.CLASS_SIZE, (cls + 1) * _gru.CLASS_SIZE)
                logits = {w: sum(h[i] * float(p["ww"][cls, i, w % _gru.CLASS_SIZE]) for i in range(u)) + float(p["ww"][cls, u, w % _gru.CLASS_SIZE]) for w in inside}
                total += logits[word] - math.log(sum(map(math.exp, logits.values())))
            x = [sum(float(p["embed"][word, i]) * float(p["wx"][i, g]) for i in range(u)) + float(p["b"][g]) for g in range(3 * u)]
            g = [sum(h[i] * float(p["wh"][i, g]) for i in range(u)) for g in range(3 * u)]
            z, r = ([sigmoid(x[k + o] + g[k + o]) for k in range(u)] for o in (0, u))
            c = [math.tanh(x[2 * u + k] + r[k] * g[2 * u + k]) for k in range(u)]
            h = [(1 - z[k]) * c[k] + z[k] * h[k] for k in range(u)]
        assert math.isclose(got, total, rel_tol=1e-4)


def test_lm_weights_do_not_depend_on_file_splits(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    one, many = (lm_scoring.train_language_model(d) for d in (docs.coalesce(1), docs.repartition(7)))
    assert np.array_equal(one.weights, many.weights) and one.trained == one.tokens == many.trained


def test_lm_scoring(spark):
    import pandas as pd

    sf = f"{DATA}/sf0.001"
    rows = queries.op6_lm_scoring(spark, sf).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")["text"]
    words = {k: lm_scoring.words_of(t.encode()) for k, t in docs.items()}
    counts = collections.Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for k, r in rows.iterrows():
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words[k])
        assert math.isclose(r.base_score, base, abs_tol=1e-6) and r.n_tokens == len(words[k]) and r.n_known == sum(counts[w] > 0 for w in words[k]) and r.train_tokens == total
    held = rows[rows["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_lm_scoring_edges(spark):
    frame = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (3, "a B a", "c"), (3, "a B a", "c")], "doc_id long, text string, score string")
    rows = lm_scoring.score_documents(frame, lm_scoring.train_language_model(frame, top=2)).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 4, 4] and all(r.score < 0 for r in rows)
    empty = lm_scoring.train_language_model(frame.limit(0))
    assert {r.n_known for r in lm_scoring.score_documents(frame, empty).collect()} == {0}
    assert lm_scoring.score_documents(frame.limit(0), empty).count() == 0


# 7 language ID


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    sizes = np.array([0, 3, 6, 1, 0, 5])
    scores = rng.normal(size=(sizes.sum(), 3)).astype("f4") * 2
    states, at = language_id.viterbi(scores, sizes, 1.5), 0
    for n in sizes:
        if n:
            value = lambda path: sum(scores[at + i, k] for i, k in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
            assert max(itertools.product(range(3), repeat=int(n)), key=value) == tuple(states[at : at + n])
        at += n


def test_language_id(spark):
    found = queries.op7_language_id(spark, f"{DATA}/sf0.01")
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").filter("held_out").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.98 and rows["score"].between(0, 1).all()


def test_language_id_edges(spark):
    teach = spark.createDataFrame([(1, "the and of", "en", 0), (2, "der und die", "de", 0), (3, "да и нет", "ru", 0), (4, None, "en", 0), (5, "x", None, 0)], "doc_id long, text string, lang string, lang_pred int")
    model = language_id.fit_language_model(teach)
    assert model.languages == ["de", "en", "ru"]
    names, shares, spans = language_id.label_texts(["the of and the the of. нет да нет да", None, "", "12 .", "и", "漢"], model, 4.0)
    assert names[1:5] == ["und", "und", "und", "ru"] and [s["lang"] for s in spans[0]] == ["en", "ru"] and names[5] in model.languages and shares[5] == 0
    assert language_id.identify_languages(teach, model).filter("lang_pred = 'und'").count() == 1
    nothing = language_id.fit_language_model(teach.limit(0))
    assert {r.lang_pred for r in language_id.identify_languages(teach, nothing).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    """The bound holds for each language: one with few rows among many is learned, and repeated ids do no harm."""
    rows = [(None if k % 2 else 7, f"the cat and the dog number {'x' * (k % 30)} run", "en") for k in range(400)] + [(9, "собака и кошка", "ru")]
    teach = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(teach, bound=20)
    assert model.languages == ["en", "ru"]
    empty = language_id.identify_languages(teach.limit(0), model)
    assert empty.count() == 0 and empty.columns[-3:] == ["lang_pred", "lang_score", "lang_spans"]
    numbers = teach.selectExpr("doc_id", "12345 AS text", "text AS lang_pred")
    assert {r.lang_pred for r in language_id.identify_languages(numbers, model).collect()} == {"und"}


def test_language_query_end_to_end(spark, tmp_path):
    """Held-out accuracy, and mixed texts labelled as a plain search over all labellings would."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    found = queries.op7_language_id(spark, f"{DATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(found) > 200 and sum(r.lang_pred == r.lang for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    model = language_id.fit_language_model(docs)
    words = "the and with from der und nicht eine que los para".split()
    rng = random.Random(1)
    for _ in range(20):
        text = " ".join(rng.choices(words, k=5))
        one = language_id.label_texts([text], model, 3.0)
        _, first, last, script, buckets = language_id._words([text])
        cuts = np.cumsum(last - first) - (last - first)
        scores = np.add.reduceat(model.weights[buckets], cuts, axis=0)
        best = max(itertools.product(range(len(model.languages)), repeat=5), key=lambda s: sum(scores[k, x] for k, x in enumerate(s)) - 3.0 * sum(a != b for a, b in itertools.pairwise(s)))
        letters = collections.Counter()
        for k, x in enumerate(best):
            letters[model.languages[x]] += int(last[k] - first[k])
        assert letters[one[0][0]] == max(letters.values())


# 8 SimHash


def test_golay_indices():
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000).astype(np.uint32)
    flips = np.r_[0, 1 << np.arange(23)].astype(np.uint32)
    near = [set(r) for r in simhash_dedup.golay_indices(words[:, None] ^ flips).tolist()]
    assert {len(n) for n in near} == {1, 6}
    for a, b in itertools.combinations(range(23), 2):
        other = words[:200] ^ np.uint32(1 << a | 1 << b)
        shared = [set(r) for r in simhash_dedup.golay_indices(other[:, None] ^ flips).tolist()]
        assert all(x & y for x, y in zip(near, shared, strict=False))


@pytest.mark.parametrize("hot", [128, 3, 0])
def test_simhash_links(spark, hot):
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 2**63, 30, dtype=np.uint64).tolist():
        for _ in range(15):
            x = base
            for bit in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << bit
            prints.add(x - 2**64 if x >= 2**63 else x)
    frame = spark.createDataFrame([(x,) for x in prints], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash_dedup.fingerprint_links(frame, hot)).collect()}
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            parent[find(a)] = find(b)
    groups = lambda f: sorted(sorted(g) for g in (lambda d: d.values())({r: [x for x in prints if f(x) == r] for r in {f(x) for x in prints}}))
    assert groups(find) == groups(lambda x: roots.get(x, x))


def test_fingerprint(spark):
    import xxhash

    def plain(text):
        words = [w for w in text.lower().split()]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    for text in ("", "a", "A b", "a b c", "the cat the cat the cat sat " * 9):
        assert simhash_dedup.fingerprint(text.encode()) == plain(text)
    assert simhash_dedup.fingerprint(None) == 0
    frame = spark.createDataFrame([(4, "a b c d", 0), (2, "A  b c d", 0), (None, None, 0), (7, "", 0), (9, "other words here", 0), (9, "other words here", 0)], "doc_id long, text string, fp int")
    rows = [(r.id, r.component_id) for r in simhash_dedup.simhash_components(frame).collect()]
    assert collections.Counter(rows) == collections.Counter([(4, 2), (2, 2), (None, 7), (7, 7), (9, 9), (9, 9)])
    assert simhash_dedup.simhash_components(frame.limit(0)).count() == 0


# 9 decontamination


@pytest.mark.parametrize("bits", [25, 9])
def test_decontamination(spark, bits):
    """A filter that lets nearly all through changes nothing."""
    rng = random.Random(0)
    some = lambda n: [f"w{rng.randint(0, 5)}" for _ in range(n)]
    items = [" ".join(some(n)) for n in (3, 6, 12, 13, 20, 30, 13)] + [None, ""]
    docs = []
    for _ in range(60):
        words = rng.choice(items[1:7]).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = some(1)[0]
        docs.append(" ".join(some(rng.randint(0, 30)) + words + some(5)))
    docs += [None, "", docs[0]]
    want, places = {}, collections.defaultdict(set)
    for a, d in enumerate(docs):
        x = (d or "").split()
        for b, t in enumerate(items):
            y = (t or "").split()
            w = min(13, len(y))
            e = 2 if w == 13 else min(2, w // 6)
            hits = [j for i in range(len(x) - w + 1) for j in range(len(y) - w + 1) if sum(p != q for p, q in zip(x[i : i + w], y[j : j + w], strict=True)) <= e] if y else []
            if hits:
                want[a, b] = (len(hits), len({j + k for j in hits for k in range(w)}))
                places[a] |= {(i, w) for i in range(len(x) - w + 1) for j in range(len(y) - w + 1) if sum(p != q for p, q in zip(x[i : i + w], y[j : j + w], strict=True)) <= e}
    frame = spark.createDataFrame([(k, d, 0) for k, d in enumerate(docs)], "doc_id long, text string, overlaps int")
    found = decontamination.find_contamination(frame, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), filter_bits=bits)
    assert {(r.doc_id, o["item"]): (o.windows, o.covered) for r in found.collect() for o in r.overlaps} == want
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    digests = {int(r["__id"]): r for r in decontamination.contaminated_documents(frame, bench, filter_bits=bits).collect()}
    for a, windows in places.items():
        inside = {k for i, w in windows for k in range(i, i + w)}
        r = digests[a]
        assert (r.windows, r.covered, r.start, r.stop) == (len(windows), len(inside), min(inside), max(inside) + 1) and r.share == pytest.approx(len(inside) / len(docs[a].split()))
        assert (a, r["item"]) in want
    assert digests.keys() == places.keys()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {len(r.overlaps) for r in decontamination.find_contamination(frame, empty).collect()} == {0}
    assert decontamination.find_contamination(frame.limit(0), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).count() == 0


def test_narrow_masks_tell_matches():
    rng = np.random.default_rng(1)
    for window, errors in ((13, 2), (8, 1), (4, 0), (1, 0)):
        for _ in range(60):
            a = rng.integers(0, 3, window).astype(np.uint64)
            b = a.copy()
            b[rng.integers(0, window, rng.integers(0, 5))] += np.uint64(1)
            shared = set(decontamination.narrow_hashes(a, errors).tolist()) & set(decontamination.narrow_hashes(b, errors).tolist())
            assert bool(shared) == (np.count_nonzero(a != b) <= errors)


def test_documents_and_items_of_one_template(spark):
    """Rows stay in proportion where every document matches every item."""
    n = 1500
    fill = lambda k, v: " ".join(f"{v}{k}" if p in (3, 7) else f"t{p}" for p in range(13))
    docs = spark.createDataFrame([(k, f"a b {fill(k, 'x')} c") for k in range(n)] + [(n, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, fill(k, "y")) for k in range(n)], "item_id long, text string")
    found = decontamination.contaminated_documents(docs, bench).collect()
    assert len(found) == n and {(r.windows, r.covered, r.start, r.stop) for r in found} == {(1, 13, 2, 15)}
    assert [r.doc_id for r in decontamination.without_contaminated(docs, bench).collect()] == [n]


def test_decontamination_unspaced_scripts_and_shared_prompts(spark):
    prompt = " ".join(f"p{k}" for k in range(20))
    items = [(k, f"{prompt} question {k}") for k in range(300)] + [(1000, "这是一个很长的问题请回答它的意思"), (1001, "はい"), (1002, "yes"), (1002, "yes")]
    docs = [(1, f"x {prompt} y"), (2, "前面的话这是一个很长的问题请回答它的意思后面的话"), (3, "Yes!"), (4, "yes and no"), (5, None), (6, "nothing of the kind " * 5000), (7, "はい。"), (8, "はいと言った")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r.overlaps for r in decontamination.find_contamination(frame, bench).collect()}
    assert len(found[1]) == 300 and {o.start for o in found[1]} <= {0, 1}
    assert [o["item"] for o in found[2]] == [1000] and [o["item"] for o in found[3]] == [1002] and [o["item"] for o in found[4]] == [1002]
    assert not found[5] and not found[6]
    kept = {r.doc_id for r in decontamination.without_contaminated(frame, bench).collect()}
    assert kept == {4, 5, 6, 8}
    assert decontamination.without_contaminated(frame.limit(0), bench).count() == 0


# 10 WARC


@pytest.mark.parametrize("k", range(9))
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(30), k=rng.randint(0, 9))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(sum(runs, []))


def test_archives_equal_sql(spark):
    con = connect(f"{DATA}/sf0.001")
    assert compare(con, queries.op10_warc(spark, f"{DATA}/sf0.001").toPandas(), queries.ORACLE_SQL["op10_warc"]) == ""


def test_archives_edges(spark):
    rows = [(1, None, None, 0), (2, "http://WWW.a.b:80/x#f", "", 0), (None, "http://a/\r\nq", "é\r\n\r\nx", 0), (4, "http://a/", "é\r\n\r\nx", 0), (4, "http://a/", "é\r\n\r\nx", 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, place int")
    found = warc.archive_captures(frame).collect()
    keys = [(r.url_key, r.warc_date) for r in found]
    assert keys == sorted(keys) and len(found) == 5
    assert collections.Counter((r.capture, r.record_type, r.refers_to, r.payload_bytes) for r in found) == collections.Counter(
        [(1, "revisit", 2, 0), (2, "response", None, 0), (None, "revisit", 4, 7), (4, "response", None, 7), (4, "response", None, 7)]
    )
    assert {r.payload_digest for r in found} == {base64.b32encode(hashlib.sha1(b).digest()).decode() for b in (b"", "é\r\n\r\nx".encode())}
    assert warc.archive_captures(frame.limit(0)).count() == 0


def test_captures_with_times_in_several_ranges(spark, tmp_path):
    """The order is global, offsets find the records, and times are the captures' own."""
    rng = random.Random(6)
    rows = [(k, f"http://{rng.choice('ab')}.org/{rng.choice(['x', 'y?q=1', ''])}", f"text {rng.randint(0, 40)}", 1700000000 + rng.randint(0, 9)) for k in range(300)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, s long").selectExpr("*", "timestamp_seconds(s) AS seen").repartition(5)
    path = f"file://{tmp_path}/archives"
    warc.write_archives(frame, path, time_col="seen", per_file=17)
    found = warc.capture_history(spark.read.format("binaryFile").load(path), ranges=4).collect()
    want = sorted((warc.url_key(u), f"2023-11-14T22:13:{20 + s - 1700000000:02d}Z", k) for k, u, _, s in rows)
    assert [r.position for r in sorted(found, key=lambda r: (r.url_key, r.warc_date, r.capture))] == list(range(300))
    assert [(r.url_key, r.warc_date, r.capture) for r in sorted(found, key=lambda r: r.position)] == want
    opened = {a: gzip.decompress(open(a.removeprefix("file:"), "rb").read()) for a in {r.archive for r in found}}
    assert len(opened) >= 300 / 17
    for r in found:
        one = list(warc.parse(opened[r.archive][r.record_offset : r.record_offset + r.record_bytes]))
        assert [(x["capture"], x["payload_digest"]) for x in one] == [(r.capture, r.payload_digest)]


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.columns == before.columns, name
        a, b = before.toPandas().set_index("doc_id"), docs.toPandas().set_index("doc_id")
        assert b.index.is_unique and set(b.index) <= set(a.index)
        if name == "language_id":
            assert len(a) == len(b)
        if name == "suffix_dedup":
            want = _removed(a["text"].tolist(), corpus_pipeline.PASSAGE)
            assert [b["text"][k] for k in a.index] == [w[0].decode("utf-8", "replace") for w in want]
        if name == "simhash_dedup":
            assert 0 < len(b) < len(a)
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(docs.toPandas()["doc_id"])


def test_pipeline_cuts_planted_passages(spark):
    """Passages of 51 to 120 words that two documents share go; documents without any stay as they are."""
    import corpus_pipeline

    rng = random.Random(8)
    own = [r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("text").collect()]
    words = [w for t in own if t for w in t.split(" ")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(rng.randint(51, 120)) for _ in range(60)]
    rows = [(k, f"{prose(80)} {p} {prose(80)}") for k, p in enumerate(passages * 2)] + [(1000 + k, prose(300)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    after = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    caught = [passages[k % 60] not in after[k] for k in range(120)]
    assert sum(caught) >= 0.95 * 120 and all(after[k] == t for k, t in rows if k >= 1000)


@pytest.mark.parametrize("stage", range(4))
def test_stages_with_odd_tables(spark, stage):
    """Nulls, repeated rows, empty tables, a missing n_chars and columns named like the operators' results."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    long = "This is one long text that has letters. " * 20
    row = lambda k, text: (k, text, "en", "p", "k", "r", "o", 7)
    rows = [row(1, None), row(2, ""), row(None, long), row(None, long), row(3, "Short text."), row(4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, Kept string, removed string, overlaps string, __id long")
    got = run(spark, docs, f"{DATA}/sf0.001")
    assert got.schema.names == docs.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    found = got.collect()
    assert {(r.lang_pred, r["Kept"], r.removed, r.overlaps, r["__id"]) for r in found} == {("p", "k", "r", "o", 7)}
    ids = sorted((r.doc_id or 0) for r in found)
    assert ids == {"language_id": [0, 0, 3], "simhash_dedup": [0, 1, 3], "suffix_dedup": [0, 0, 1, 2, 3, 4], "decontamination": [0, 0, 1, 2, 3, 4]}[name]
    if name == "suffix_dedup":
        assert [r.text for r in found if r.doc_id in (1, 2)] == [None, ""] or [r.text for r in found if r.doc_id in (1, 2)] == ["", None]
        assert all(len(r.text) < len(long) for r in found if r.doc_id is None)
    assert run(spark, docs.limit(0), f"{DATA}/sf0.001").count() == 0


def test_packing_stage_with_odd_tables(spark):
    """Nulls, repeated rows and columns named like the results; each row's pieces are packed, whatever its id."""
    import corpus_pipeline

    rows = [(1, None, "a", 1), (2, "", "b", 2), (None, "Some words.", "c", 3), (None, "Some words.", "c", 3), (3, "word " * 5000, "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, piece long")
    name, pack = corpus_pipeline.STAGES[-1]
    got = pack(spark, docs, "").collect()
    pieces = collections.Counter(r.doc_id for r in got)
    assert name == "best_fit_packing" and pieces[1] == pieces[2] == 1 and pieces[None] == 2 and pieces[3] > 1
    assert all(0 < r.length <= 2048 for r in got) and pack(spark, docs.limit(0), "").count() == 0
