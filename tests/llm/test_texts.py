"""Tokens, packing, pages, media, the language model, toxicity and the pipeline."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestore.llm import byte_bpe, html_text, media, packing, pitman_yor, token_counts, toxicity, webp

RANKS, WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))


# ---------------------------------------------------------------- tokens


def test_bpe_equals_library(spark, docs, texts):
    ranks = byte_bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {r.doc_id: r.ids for r in byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()}
    digests = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert ids[i] == want and digests[i].n_tokens == len(want)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("piece", ["a" * 700, "ab" * 300, "漢字" * 90, "!?" * 200, "0" * 99])
def test_bpe_of_long_pieces(piece):
    ranks = byte_bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert byte_bpe.encode_piece(piece.encode(), ranks) == library.encode_ordinary(piece)


def test_token_counts_look_no_further_than_a_suffix():
    class Asked(dict):
        n = 0

        def get(self, key, default=None):
            Asked.n += 1
            return dict.get(self, key, default)

    trie = token_counts.Trie({c: -1_000_000 for c in "abcdefgh"} | {"ab": -1_500_000, "x" * 8: -2_000_000})
    trie.pieces, trie.suffixes = Asked(trie.pieces), Asked(getattr(trie, "suffixes", {}))
    assert [trie.count("abcdefgh"), trie.count("ab" + "é" * 3)] == [7, 7] and Asked.n <= 2 * 13


def test_token_counts_equal_plain_recursion(spark, docs, texts, monkeypatch):
    pieces = token_counts.load_pieces(PIECES)
    longest = max(map(len, pieces))

    def plain(text):
        text = "▁" + text.replace(" ", "▁")
        best = [(0, 0)]
        for e in range(1, len(text) + 1):
            options = []
            for s in range(max(0, e - longest), e):
                p = pieces.get(text[s:e])
                if p is not None:
                    options.append((best[s][0] + p, best[s][1] - 1))
                elif s == e - 1:
                    options.append((best[s][0] + token_counts.UNKNOWN, best[s][1] - len(text[s].encode())))
            best.append(max(options))
        return -best[-1][1]

    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PIECES).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) if t else 0 for t in texts]
    small = token_counts.Trie(pieces, nodes=10)  # emptied again and again
    assert sum(small.count(w) for w in token_counts.pre_tokens(texts[12])) == got[12]


# ---------------------------------------------------------------- packing


def test_packing_keeps_every_id_once(spark, docs, texts):
    library = Tokenizer.from_file(WORD_BPE)
    want = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in enumerate(texts)}
    rows = packing.pack(docs.repartition(3), WORD_BPE, window_count=4).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[r.doc_id])
    for i in want:
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(want[i])
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, want.values()))
    assert len(sequences) <= total / 2048 * 1.2 + 2


def test_word_parts_equal_library():
    library, mine = Tokenizer.from_file(WORD_BPE), packing.WordEncoder(WORD_BPE)
    odd = ["don't I'LL ''s", "ÀÉ ß µm x² ½ ª\x85b\xa0c\x1fd", "a\x0bb\x0cc", "é İ ΣΑΣ", "<|endoftext|> </w> </w", "a <|endoftext|> b", "x<|startoftext|>Y 漢", "<|endoftext", ""]
    for t, data in zip(odd, mine.batch(odd, 1), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]


def test_the_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 20)
    library, mine = Tokenizer.from_file(WORD_BPE), packing.WordEncoder(WORD_BPE)
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdé漢") for _ in range(r.choice([1, 3, 90]))) for _ in range(15)) for _ in range(60)]
    for _ in range(2):
        for t in texts:
            (data,) = mine.batch([t], 1)
            assert np.frombuffer(data, "<u4").tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]
            assert len(mine.young) <= 50 and len(mine.old) <= 50 and all(len(w) <= packing.SHORT for w in mine.young)


def test_packing_of_an_empty_table(empty):
    assert packing.pack(empty, WORD_BPE).count() == 0


# ---------------------------------------------------------------- pages


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


LONG = "This paragraph has a good many words in it so that it is dense, as an article is."


@pytest.mark.parametrize(("html", "want"), [
    (None, ""),
    ("", ""),
    (page("<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>x\n y<br>z<p>un&eacute;</article><footer>&copy;</footer>"), "A & B\nx y z\nuné"),
    (page(f"<div id=header>Site</div><div class='sidebar'><p>{LONG}</p></div><div id=content><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div>"), f"Head\n{LONG}\nShort.\n{LONG}"),
    (page(f"<article><p>{LONG}</p><form><p>Mail</p></form><aside>ad</aside><div class='ad'>Buy</div><p>End"), f"{LONG}\nEnd"),
    ("<article><p>cut &lt;b&gt; <b>off", "cut <b> off"),
])
def test_pages(html, want):
    assert html_text.extract(html) == want


@pytest.mark.parametrize(("html", "want"), [
    (page(f"<main><p>{LONG}</p><p>{LONG}</p><article><p>A short teaser.</p></article></main>"), f"{LONG}\n{LONG}\nA short teaser."),
    (page(f"<div><article><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p></article></div>"), f"{LONG}\n{LONG}\n{LONG}"),
    (page(f"<div><p>{LONG}</p><p>Intro.</p><p>{LONG}</p><section><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section></div>"), f"{LONG}\nIntro.\n" + "\n".join([LONG] * 4)),
    (page(f"<article><h1>Title</h1><section><p>{LONG}</p><p>{LONG}</p></section></article>"), f"Title\n{LONG}\n{LONG}"),
])
def test_clusters_choose_the_container(html, want):
    assert html_text.extract(html) == want


@pytest.mark.parametrize("name", ["page has-sidebar", "no-footer", "with-menu", "menu-page", "site-header-layout"])
def test_named_wrappers_keep_the_article(name):
    inner = f"<article><h1>Head</h1><p>{LONG}</p></article><div class=sidebar><p>{LONG}</p></div>"
    assert html_text.extract(page(f"<div class='{name}'>{inner}</div>")) == f"Head\n{LONG}"
    assert html_text.extract(page(f"<div class='{name}'><p>{LONG}</p><p>{LONG}</p></div><p>Tail")).startswith(f"{LONG}\n{LONG}")


@pytest.mark.parametrize("name", ["entry-header", "post-header"])
def test_article_headers_stay(name):
    assert html_text.extract(page(f"<div class=header>Site</div><article><div class='{name}'><h1>Head</h1></div><p>{LONG}</p><div class='comments'><article class=comment><p>{LONG}</p></article></div></article>")) == f"Head\n{LONG}"


@pytest.mark.parametrize(("html", "want"), [
    (page(f"<form id=aspnetForm><div class=nav><a>Home</a></div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><input name=q></form>"), f"Head\n{LONG}\n{LONG}"),
    (page(f"<form><article><h1>Head</h1><p>{LONG}</p></article><p>{LONG}</p></form>"), f"Head\n{LONG}"),
    (page(f"<div id=c><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><form class=contact><p>Write to us about this page and more.</p></form>"), f"Head\n{LONG}\n{LONG}"),
    (page(f"<div class='post category-legal'><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div>"), f"Head\n{LONG}\n{LONG}"),
    (page(f"<div class=story><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><section id=reader><article><p>{LONG}</p><p>{LONG}</p></article></section>"), "\n".join([LONG] * 3)),
])
def test_forms_and_readers(html, want):
    assert html_text.extract(html) == want


def test_all_pages_against_a_plain_reading():
    """Every page of the test data: the blocks of its only article, cut out by patterns."""
    import html as entities

    import duckdb

    found = duckdb.sql("select html from read_parquet('/root/testdata/sf0.01/pages.parquet')").fetchall()
    assert len(found) > 50
    for (text,) in found:
        assert text.count("<article") == 1
        body = re.search(r"<article[^>]*>(.*)", text, re.S)[1].split("</article>")[0]
        body = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", body, flags=re.S)
        body = re.split(r"<footer", body)[0]
        blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", re.sub(r"<br[^>]*>", " ", body))
        plain = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert html_text.extract(text) == "\n".join(b for b in plain if b)


def laid_out(r):
    """(html, text) of a made-up page: an article in one of many layouts, and parts around it that are not the article."""
    sentence = lambda n: " ".join("".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(n)).capitalize() + "."
    blocks = [sentence(r.randint(2, 5))] + [" ".join(sentence(r.randint(6, 14)) for _ in range(r.randint(2, 4))) for _ in range(r.randint(4, 8))]
    blocks.insert(r.randint(2, len(blocks) - 1), sentence(3))
    inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b} </p>\n" if k % 3 else f"<p>{b.replace(' ', ' <em>', 1)}</em>" for k, b in enumerate(blocks[1:]))
    if r.random() < 0.5:
        inner += r.choice(["<script>var x = '<p>no</p>';</script>", "<div class=ad>Buy this thing now</div>", f"<aside><p>{sentence(9)}</p></aside>", f"<form class=newsletter><p>{sentence(8)}</p><input></form>"])
    links = "".join(f"<li><a href=/{k}>{sentence(2)}</a></li>" for k in range(r.randint(4, 9)))
    layout = r.choice([
        "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div id=content>{}</div>", "<div class='post category-legal'>{}</div>", "<div class='layout with-sidebar'><div>{}</div></div>",
        "<div id=page class=has-header><section>{}</section></div>", "<form id=aspnetForm><div class=story>{}</div></form>", "<div role=main>{}</div>", "<table><tr><td>{}</td></tr></table>",
    ])
    before = r.sample([f"<nav><ul>{links}</ul></nav>", f"<div class=menu><ul>{links}</ul></div>", f"<header><p>{sentence(4)}</p></header>", f"<div id=header>{sentence(4)}</div>", f"<div class='cookie-notice'><p>{sentence(12)}</p></div>"], r.randint(1, 3))
    after = r.sample([f"<footer>&copy; {sentence(5)}</footer>", f"<div class=sidebar><p>{sentence(9)}</p></div>", f"<div class=related><ul>{links}</ul></div>", f"<div id=comments><p>{sentence(12)}</p><p>{sentence(9)}</p></div>", f"<section class=reader-comments><article><p>{sentence(14)}</p></article></section>"], r.randint(1, 3))
    return page("".join(before) + layout.format(inner) + "".join(after)), "\n".join(blocks)


def test_made_up_layouts():
    r = random.Random(12)
    for k in range(300):
        html, want = laid_out(r)
        assert html_text.extract(html) == want, (k, html)


def test_page_table(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, page("<article><p>é😀</article>"))], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract_pages(df).collect()) == [("1", "", 0), ("None", "é😀", 2)]


# ---------------------------------------------------------------- media


def images():
    r = np.random.default_rng(1)
    for w, h in ((1, 1), (5, 3), (33, 17)):
        n = w * h
        yield w, h, r.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        yield w, h, np.full(n, 7, np.uint32)
        yield w, h, r.integers(0, 3, n).astype(np.uint32) * np.uint32(0x01020304)
        yield w, h, np.tile(r.integers(0, 200, 11).astype(np.uint32), n // 11 + 1)[:n]


def test_webp_round_trips():
    r = random.Random(3)
    for w, h, px in images():
        blocks = -(-w // 4) * -(-h // 4)
        cross = [r.randrange(1 << 24) | 0xFF000000 for _ in range(blocks)]
        choices = [None, [("subtract",)], [("cross", 2, cross)], [("predictor", 2, [r.randrange(14) << 8 for _ in range(blocks)]), ("cross", 2, cross), ("subtract",)]]
        choices += [[("predictor", 2, [m << 8] * blocks)] for m in range(14)]
        if len(np.unique(px)) <= 256:
            choices.append([("palette",)])
        for transforms in choices:
            for cache in (None, 0, 11):
                back, a, b = webp.decode(webp.encode(px, w, h, transforms, cache))
                assert (a, b) == (w, h) and (back == px).all()


@pytest.mark.parametrize(("file", "pixel"), [
    ("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", 0),
    ("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=", 0xFFFFFFFF),
])
def test_webp_files_of_another_encoder(file, pixel):
    pixels, width, height = webp.decode(base64.b64decode(file))
    assert (pixels.tolist(), width, height) == ([pixel], 1, 1)


class Stream:
    """Bits written one after another, lowest first, as the format's description has them: no code of the encoder's."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def single(self, *symbols):
        """A simple code of one or two symbols of eight bits."""
        self.put(1, 1)
        self.put(len(symbols) - 1, 1)
        self.put(1, 1)
        for s in symbols:
            self.put(s, 8)

    def image(self, colour, main=False):
        """One colour everywhere: five codes of one symbol each and no bits for pixels."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        a, r, g, b = colour
        for s in (g, r, b, a):
            self.single(s)
        self.single(0)

    def file(self):
        body = bytes([0x2F]) + bytes(sum(b << i for i, b in enumerate(self.bits[k : k + 8])) for k in range(0, len(self.bits), 8))
        chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
        return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def by_hand(transforms, width=5, height=3):
    s = Stream()
    s.put(width - 1, 14)
    s.put(height - 1, 14)
    s.put(1, 1)
    s.put(0, 3)
    for kind, colour in transforms:
        s.put(1, 1)
        s.put(kind, 2)
        if kind < 2:
            s.put(0, 3)
            s.image(colour)
        elif kind == 3:
            s.put(0, 8)
            s.image(colour)
    return s


def test_webp_transforms_by_hand():
    """Files written bit by bit, whose pixels follow from the format's rules."""
    s = by_hand([(0, (255, 0, 1, 0))])  # predictor: left
    s.put(0, 1)
    s.image((0, 1, 2, 3), main=True)
    pixels, w, h = webp.decode(s.file())
    want = [(255 & 0xFF, (x + y + 1) & 255, 2 * (x + y + 1), 3 * (x + y + 1)) for y in range(h) for x in range(w)]
    assert [tuple(int(v) >> k & 255 for k in (24, 16, 8, 0)) for v in pixels] == want
    s = by_hand([(0, (255, 0, 7, 0))])  # predictor: mean of left and top
    s.put(0, 1)
    s.image((0, 2, 0, 0), main=True)
    red = [[0] * 5 for _ in range(3)]
    for y in range(3):
        for x in range(5):
            guess = 0 if not x and not y else red[y][x - 1] if not y else red[y - 1][x] if not x else (red[y][x - 1] + red[y - 1][x]) // 2
            red[y][x] = guess + 2
    assert [int(v) >> 16 & 255 for v in webp.decode(s.file())[0]] == [v for row in red for v in row]
    s = by_hand([(1, (255, 32, 224, 16))])  # cross-colour: red to blue 1, green to blue -1, green to red 1/2
    s.put(0, 1)
    s.image((9, 10, 200, 5), main=True)
    green = 200 - 256
    new_red = 10 + (16 * green >> 5) & 255
    signed = new_red - 256 if new_red > 127 else new_red
    assert set(map(int, webp.decode(s.file())[0])) == {9 << 24 | new_red << 16 | 200 << 8 | 5 + (-32 * green >> 5) + (32 * signed >> 5) & 255}
    s = by_hand([(2, None), (3, (1, 2, 3, 4))])  # a palette of one colour below subtract-green
    s.put(0, 1)
    s.image((255, 0, 0, 0), main=True)
    assert set(map(int, webp.decode(s.file())[0])) == {1 << 24 | 2 + 3 << 16 | 3 << 8 | 4 + 3}


def test_transforms_are_chosen_where_they_are_smaller():
    r = np.random.default_rng(2)
    n = 4096
    samples = {
        "left": np.cumsum(r.integers(0, 3, (n, 4)), axis=0).astype(np.uint8),
        "above": np.cumsum(r.integers(0, 3, (n // 16, 16, 4)), axis=0).astype(np.uint8).reshape(n, 4),
        "cross": np.stack([(g := r.integers(0, 256, n)) + r.integers(0, 4, n), g, g + r.integers(0, 4, n), np.full(n, 7)], axis=1).astype(np.uint8),
        "none": r.integers(97, 123, (n, 4)).astype(np.uint8),
    }
    for name, a in samples.items():
        data = a.tobytes()
        chosen = media.transforms_of(np.frombuffer(data, "<u4"))
        assert {"none": chosen is None, "cross": chosen and chosen[0][0] == "cross"}.get(name, chosen and chosen[0][0] == "predictor"), name
        stored = media.encode_payload(data)
        assert b"".join(x.tobytes() for x in media.decode_media(stored)) == data
        plain = webp.encode(np.frombuffer(data, "<u4"), 16, n // 16, alike=True)
        assert len(stored) < 0.9 * len(plain) or name == "none"


def test_webp_rejects_broken_files():
    data = webp.encode(np.arange(600, dtype=np.uint32) * 77777, 30, 20)
    for bad in (b"RIFFxxxxWEBPVP8 ", data[:40], data[: len(data) // 2]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_media_columns(spark, docs, texts):
    from pyspark.sql import functions as F

    stored = media.store(docs.select("doc_id", F.encode("text", "UTF-8").alias("payload")), "doc_id", "payload")
    got = {r.doc_id: r for r in media.read_back(stored, "doc_id").collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(data), len(padded))
        assert got[i].payload_sha256 == hashlib.sha256(padded).hexdigest() and got[i].tail_crc32 == zlib.crc32(padded[-64:])
    assert b"".join(x.tobytes() for x in media.decode_media(media.encode_payload(bytes(1_100_000)))) == bytes(-(-1_100_000 // 64) * 64)


# ---------------------------------------------------------------- language model


@pytest.mark.parametrize("class_tokens", [1 << 20, 300])
def test_model_base_and_gain(spark, docs, texts, monkeypatch, class_tokens):
    """Also with so small classes that contexts and pairs are split, and runs of a few texts."""
    monkeypatch.setattr(pitman_yor, "CLASS_TOKENS", class_tokens)
    monkeypatch.setattr(pitman_yor, "HEAD", 20 if class_tokens > 300 else 5)
    monkeypatch.setattr(pitman_yor, "RUN_TOKENS", 1 << 20 if class_tokens > 300 else 2000)
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in pitman_yor.score_documents(docs).collect()}
    assert len(got) == len(texts)
    for i, ws in enumerate(words):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-12)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def trigrams(rng, long, short, types):
    """(long, short, word, count), sorted as a class has them; long contexts are spread over the short ones."""
    rows = {(k, k % short, w): 0 for k in range(long) for w in range(types)}
    for k, s, w in rows:
        if k:  # one restaurant stays empty
            rows[k, s, w] = int(rng.poisson(rng.gamma(0.4, 2.0) * (1 + (w + s) % 3)))
    rows[2, 2 % short, 0] = 400  # beyond the exact numbers
    found = sorted((s, w, k, n) for (k, s, w), n in rows.items())
    s, w, k, n = (np.array(x) for x in zip(*found, strict=True))
    return k, s, w, n


def test_model_is_a_distribution():
    types = 12
    root = np.random.default_rng(1).dirichlet(np.ones(types))
    long, short, word, count = trigrams(np.random.default_rng(4), 9, 3, types)
    p = pitman_yor.Seating(long, short, word, count, types).sampled(root, np.random.default_rng(2))
    assert np.bincount(long, weights=p) == pytest.approx(np.ones(9), abs=1e-9)


class Franchise:
    """The same model by the plain sampler: one customer after another leaves and is seated anew."""

    def __init__(self, long, short, word, count, root, d, strength, random):
        self.root, self.d, self.strength, self.random = root, d, strength, random
        self.parent = dict(zip(long.tolist(), short.tolist(), strict=True))
        self.tables = {"long": defaultdict(list), "short": defaultdict(list)}  # (place, word) -> customers of each table
        self.customers = [(k, w) for k, w, n in zip(long.tolist(), word.tolist(), count.tolist(), strict=True) for _ in range(n)]
        self.total = {"long": Counter(), "short": Counter()}
        self.open = {"long": Counter(), "short": Counter()}
        for k, w in self.customers:
            self.add("long", k, w)

    def p(self, level, place, w):
        base = self.p("short", self.parent[place], w) if level == "long" else self.root[w]
        tables = self.tables[level].get((place, w), [])
        own = sum(tables) - self.d[level] * len(tables)
        return (own + (self.strength[level] + self.d[level] * self.open[level][place]) * base) / (self.strength[level] + self.total[level][place])

    def add(self, level, place, w):
        base = self.p("short", self.parent[place], w) if level == "long" else self.root[w]
        tables = self.tables[level][place, w]
        weights = [n - self.d[level] for n in tables] + [(self.strength[level] + self.d[level] * self.open[level][place]) * base]
        at = self.random.choices(range(len(weights)), weights)[0]
        self.total[level][place] += 1
        if at < len(tables):
            tables[at] += 1
            return
        tables.append(1)
        self.open[level][place] += 1
        if level == "long":
            self.add("short", self.parent[place], w)

    def remove(self, level, place, w):
        tables = self.tables[level][place, w]
        at = self.random.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        self.total[level][place] -= 1
        if not tables[at]:
            tables.pop(at)
            self.open[level][place] -= 1
            if level == "long":
                self.remove("short", self.parent[place], w)

    def sweep(self):
        for k, w in self.customers:
            self.remove("long", k, w)
            self.add("long", k, w)


def test_seating_against_the_plain_sampler(monkeypatch):
    """Predictive probabilities of blocked and of one-by-one sampling agree, and so do the tables that go up."""
    types = 6
    rng = np.random.default_rng(8)
    long, short, word, count = trigrams(rng, 8, 2, types)
    count = np.minimum(count, 9)
    root = rng.dirichlet(np.ones(types) * 2)
    monkeypatch.setattr(pitman_yor, "BURN", 100)
    monkeypatch.setattr(pitman_yor, "SAMPLES", 4000)
    seating = pitman_yor.Seating(long, short, word, count, types)
    mine = seating.sampled(root, np.random.default_rng(3))
    plain = Franchise(long, short, word, count, root, {"long": seating.d, "short": seating.short_d}, {"long": pitman_yor.LONG_STRENGTH, "short": pitman_yor.SHORT_STRENGTH}, random.Random(5))
    total, turns = np.zeros(len(count)), 1500
    for k in range(100 + turns):
        plain.sweep()
        if k >= 100:
            total += [plain.p("long", x, y) for x, y in zip(long.tolist(), word.tolist(), strict=True)]
    assert np.abs(mine - total / turns).max() < 0.012 and np.abs(np.log(mine / (total / turns))).max() < 0.12


def test_tables_of_one_dish_against_enumeration():
    d, most = 0.6, 7
    table = pitman_yor.stirling(most + 1, d)
    weights = {0: 1.0}  # by hand: a customer joins one of t tables (c - d * t) or opens one (a)
    a, rng = 1.7, np.random.default_rng(0)
    weights = {1: a}
    for c in range(1, most):
        weights = {t: weights.get(t, 0) * (c - d * t) + weights.get(t - 1, 0) * a for t in range(1, c + 2)}
    drawn = pitman_yor.draw_tables(np.full(200_000, most), np.full(200_000, a), d, table, rng)
    for t, w in weights.items():
        assert (drawn == t).mean() == pytest.approx(w / sum(weights.values()), abs=0.005)
    two = pitman_yor.draw_tables(np.array([0, 1, *[2] * 100_000]), np.full(100_002, a), d, table, rng)
    assert two[:2].tolist() == [0, 1] and (two[2:] == 2).mean() == pytest.approx(a / (1 - d + a), abs=0.006)


def test_packed_arrays():
    rng = np.random.default_rng(1)
    arrays = [np.empty(0, np.int64), rng.integers(0, 200, 7), rng.integers(0, 1 << 40, 9).astype(np.uint64), rng.normal(size=5), rng.normal(size=3).astype("<f4"), np.array([1 << 63], dtype=np.uint64)]
    for a, b in zip(arrays, pitman_yor.unpack(pitman_yor.pack(*arrays)), strict=True):
        assert a.tolist() == b.tolist()
    values = rng.integers(0, 70_000, 1000)
    for most in (70_000, 1 << 16):
        v = values % most
        assert (pitman_yor._summed(pitman_yor._steps(v, most), most) == v).all()


def test_model_shares_words_between_classes(spark, monkeypatch):
    """A word frequent after some contexts is likely after new ones, in whatever class they are."""
    monkeypatch.setattr(pitman_yor, "CLASS_TOKENS", 700)  # several classes, and no context is split
    training = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 1]
    # both words are frequent; one of them follows a single context
    data = [(i, (f"before{k % 12} common", "alone other", f"rare{k} scarce{k}")[k % 3]) for k, i in enumerate(training)]
    data += [(i, f"new{k // 2} {'common' if k % 2 else 'other'}") for k, i in enumerate(held)]
    got = {r.doc_id: r.score for r in pitman_yor.score_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    gains = [got[b] - got[a] for a, b in zip(held[::2], held[1::2], strict=False)]
    assert np.median(gains) > 0.3 and np.mean(np.array(gains) > 0.3) > 0.9


def test_model_without_training_rows(spark, empty):
    assert pitman_yor.score_documents(empty).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    rows = pitman_yor.score_documents(only).collect()
    assert rows and all(r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in rows)


# ---------------------------------------------------------------- toxicity and the pipeline


def toxic_tables(spark, texts):
    r = random.Random(8)
    clean = [t for t in texts if t and len(t) < 2000]
    data, labels = [], []
    for i in range(300):
        words = r.choice(clean).split()
        bad = i % 4 == 0
        if bad:
            words[r.randrange(len(words) + 1) : 0] = [r.choice(["horridbeast", "vilecreature"])]
        data.append((i, " ".join(words), "en", "s", None))
        labels.append((i, None, int(bad)))
    data += [(300, None, None, None, None), (301, "", None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([*labels, (2, None, None), (None, None, 1)], "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark, texts, empty):
    docs, labels, marks = toxic_tables(spark, texts)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.classify(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(m) for i, _, m in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) >= 0.95
    assert got[300] == got[301] < 0.5
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in got.items() if s < 0.5)
    nothing = toxicity.train(empty, labels)
    assert toxicity.classify(docs, nothing).where("score >= 0.5").count() == 0


def plain_score(text, model):
    """The score by its definition, one n-gram after another."""
    weights, bias = model
    clean = re.sub(r"\s+", " ", (text or "").lower()).strip()
    clean = f" {clean} " if clean else ""
    cells = set()
    for n in toxicity.ORDERS:
        for i in range(len(clean) - n + 1):
            h = 0
            for c in clean[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            cells.add((h ^ n) * 0xD6E8FEB86659FD93 % 2**64 >> 64 - toxicity.BITS)
    return 1 / (1 + math.exp(-(bias + sum(float(weights[c]) for c in cells))))


def test_scores_against_a_plain_version(spark, texts):
    docs, labels, _ = toxic_tables(spark, texts)
    model = toxicity.train(docs, labels)
    for r in toxicity.classify(docs, model).join(docs.select("doc_id", "text"), "doc_id").where("doc_id % 9 = 0 or doc_id > 298").collect():
        assert r.score == pytest.approx(plain_score(r.text, model), abs=1e-5)


def test_training_with_odd_ids_and_repeats(spark, texts):
    docs, labels, marks = toxic_tables(spark, texts)
    from pyspark.sql import functions as F

    named = docs.withColumn("doc_id", F.concat(F.lit("x"), "doc_id")).withColumn("score", F.lit("kept"))
    marked = labels.withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))
    model = toxicity.train(named.unionByName(named), marked)
    got = {r.doc_id: r.score for r in toxicity.classify(named, model).collect()}
    assert np.mean([(got[f"x{i}"] >= 0.5) == bool(m) for i, _, m in marks]) >= 0.95
    assert toxicity.reject(named, model).columns == named.columns
    same = [toxicity.train(named, marked) for _ in range(2)]
    assert (same[0][0] == same[1][0]).all() and same[0][1] == same[1][1]


def test_pipeline_against_a_plain_version(spark, texts, tmp_path):
    """Every stage by its definition over the same documents: what stays, what the texts become, and how they are packed."""
    import corpus_pipeline
    from test_duplicates import brute
    from test_secrets import base, entropy

    docs, labels, marks = toxic_tables(spark, texts)
    more = [(400, "the token = 0123456789abcdef0123 is here", "en", "s", 40), (401, "key " + "0a1b2c3d" * 6 + " end", "en", "s", 4), (402, "word " * 5000, "en", "s", 5), (403, "the token = 0123456789abcdef0123 is here", "de", "t", 40)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    table = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), labels)
    clean = {i: t for i, t in table.items() if plain_score(t, model) < 0.5}
    assert 0 < len(clean) < len(table)
    names = sorted(clean)
    _, roots = brute([clean[i] for i in names])
    left = {i: clean[i] for k, i in enumerate(names) if roots[k] == k}
    assert len(left) < len(clean) and 403 not in left
    library, want = Tokenizer.from_file(WORD_BPE), {}
    for i, t in left.items():
        out, at = "", 0
        for start, _, end in sorted((a, -b, b) for a, _, b in base(t or "") + entropy(t or "")):
            if start >= at:
                out += t[at:start] + "[secret]"
            at = max(at, end)
        want[i] = [*library.encode(out + (t or "")[at:], add_special_tokens=False).ids, 1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want)
    for i, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want[i])) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(want[i][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(want[i])
    windows = defaultdict(list)
    for r in packed:
        windows[r.sequence_id].append((r.offset, r.length))
    for found in windows.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "secrets", "packing"]
