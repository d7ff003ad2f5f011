"""Kernels against plain Python."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillveil.llm import docstats, media, neardup, packing, toxicity, webp
from quillveil.llm import textkernel as tk
from quillveil.llm.classifier import fit_trees
from quillveil.llm.mixing import _pivot

TEXTS = ["", " \t\n", "a", "One two  three\nfour\x0bfive", "é\xa0ü x", "A a A a A a A a b b", "x" * 5000 + " y", "\n\na\na\n a\n", None]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _sets(texts, k):
    out = []
    for t in texts:
        w = WORD.findall(_lower(t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t*é😀", max_size=60), max_size=8))
def test_words_and_shingles(texts):
    for part in tk.slices(pa.array(texts, pa.string())):
        found = tk.words(part)
        assert found.counts.tolist() == [len(WORD.findall(t)) for t in texts]
        hashes, bounds = tk.shingle_sets(tk.words(part, lower=True), 2)
        assert np.diff(bounds).tolist() == [len(s) for s in _sets(texts, 2)]


def test_slices_cover_all_texts(monkeypatch):
    monkeypatch.setattr(tk, "SLICE_BYTES", 10)
    parts = list(tk.slices(pa.array(TEXTS).slice(2)))
    assert sum(len(p) for p in parts) == len(TEXTS) - 2
    assert b"".join(p.buf.tobytes() for p in parts).decode() == "".join(t or "" for t in TEXTS[2:])


def test_counts_against_brute_force():
    import collections

    texts = TEXTS + ["w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3, "a b c d e f g h a b c d e f g h", "x #*$ y%&\nx #*$ y%&\n<>|"]
    got: dict = collections.defaultdict(list)
    for part in tk.slices(pa.array(texts)):
        for k, v in docstats.counts(part).items():
            got[k] += v.tolist()
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[k][i] for k in docstats.BASE) == expected, t


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2000).astype(np.uint64)
    a, b = np.sort(base[:1600]), np.sort(base[400:])
    sig = neardup.circulant_signature(np.concatenate([a, b]), np.array([0, 1600, 3200]), 512)
    assert abs((sig[0] == sig[1]).mean() - 1200 / 2000) < 0.08


def test_packer_fills_windows_and_loses_nothing():
    packer = packing.SumOfSquaresPacker(64)
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 200, 500)
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n, dtype=np.uint32))
    windows = packer.take_closed() + packer.drain()
    assert sum(w.fill for w in windows) == sizes.sum()
    assert all(w.fill == 64 or w.fill & (w.fill - 1) == 0 for w in windows)
    pieces = sorted((d, s, len(x)) for w in windows for d, s, x, _ in w.pieces)
    ends = {i: 0 for i in range(500)}
    for d, s, n in pieces:
        assert s == ends[d]
        ends[d] += n
    assert ends == dict(enumerate(sizes))


def test_few_windows_stay_open_with_coarse_levels():
    packer = packing.SumOfSquaresPacker(4096, 128)
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 5000, 800), np.full(200, 2100)])
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n, dtype=np.uint32))
    assert sum(w.fill for w in packer.closed) > 0.95 * sizes.sum() and all(w.fill == 4096 for w in packer.closed)
    windows = packer.take_closed() + packer.drain()
    assert sum(w.fill for w in windows) == sizes.sum()


def test_classes_of_code_points_are_those_of_the_tokenizer():
    P = pytest.importorskip("public_tokenizers")
    own = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    cut = own.tokenizer.pre_tokenizer.pre_tokenize_str
    kinds = own.classes
    codes = [c for c in range(1, 0x110000) if kinds[c] != packing._UNKNOWN and not 0xD800 <= c < 0xE000 and not 0x3400 < c < 0xD7A0 and c < 0x20000]
    # between letters a letter joins them, between marks a mark does, a digit stands alone and white space goes
    joined = {packing._LETTER: (1, 3), packing._OTHER: (3, 1), packing._DIGIT: (3, 3), packing._SPACE: (2, 2)}
    plain = lambda t: own.tokenizer.normalizer.normalize_str(t)
    for c in codes[::3]:
        if len(plain(chr(c))) == 1 and ord(plain(chr(c))) == c:
            assert (len(cut(f"z{chr(c)}q")), len(cut(f"?{chr(c)}?"))) == joined[kinds[c]], hex(c)


def test_sum_of_squares_choice():
    packer = packing.SumOfSquaresPacker(10)
    packer.counts[3], packer.counts[5], packer.counts[6] = 4, 1, 1
    brute = {}
    for h in (0, 3, 5, 6):
        c = packer.counts.copy()
        if h + 4 <= 10:
            if h:
                c[h] -= 1
            if h + 4 < 10:
                c[h + 4] += 1
            brute[h] = int((c[1:10] ** 2).sum())
    assert brute[packer.level_for(4)] == min(brute.values())


def test_word_tokenizer_equals_the_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = ["", "  ", "Don't 12 a1b2 it's", "ΣΑΣ ÀÉ́ İ", "x　z ½ ٣ '’ !!'s", "hello hello, world\n\n#*$", "<|endoftext|> a"]
    own, lib = packing.WordTokenizer(path), Tokenizer.from_file(path)
    assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
    odd = ["a\u1c89b", "x \ua7cb9", "\U000105c0 hello", "plain"]
    assert [x.tolist() for x in own.encode(odd)] == [x.ids for x in lib.encode_batch(odd, add_special_tokens=False)]
    own._forget()
    assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_pivot_keeps_words_and_rounds_all():
    rng = np.random.default_rng(3)
    size, taken = rng.integers(1, 100, 400).astype(float), []
    for seed in range(50):
        out = _pivot(np.full(400, 0.3), size, np.random.default_rng(seed).random(400), True)
        assert set(out.tolist()) <= {0.0, 1.0}
        assert abs((out * size).sum() - 0.3 * size.sum()) <= size.max()
        taken.append(out)
    assert abs(np.mean(taken) - 0.3) < 0.03


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = fit_trees(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert fit_trees(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("text, hits", [("you idiot", 1), ("you 1d10t!", 1), ("IDIOT IDIOT", 2), ("іdіоt", 1), ("ｉｄｉｏｔ", 1), ("idi​ot", 1), ("idiotic clown fish", 1), ("clowns", 0), ("a trash can", 0), ("moron*** $", 1), ("", 0)])
def test_lexicon(text, hits):
    machine = toxicity.Model().machine()
    assert toxicity.weigh(machine, text)[0] == hits


# --- WebP --------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=600))
def test_payload_round_trip(raw):
    payload = media.payload_of(np.frombuffer(raw, np.uint8))
    pixels = media.pixels_of(payload)
    stored = webp.encode(pixels)
    assert webp.decode(stored).tobytes()[: len(payload)] == raw + b"\0" * (len(payload) - len(raw))
    assert len(payload) % 64 == 0 and len(payload) > 0


def _image(bits, symbols_of, extra=b""):
    return webp.riff(bits.bytes())


def _head(width, height):
    bits = webp.BitWriter()
    webp.header(bits, width, height)
    return bits


def _two(bits, a, b):
    """A simple code of two symbols."""
    bits.put(1, 1), bits.put(1, 1), bits.put(1, 1), bits.put(a, 8), bits.put(b, 8)


def _constant_image(bits, argb, meta=False):
    bits.put(0, 1)
    if meta:
        bits.put(0, 1)
    for s in (8, 16, 0, 24):
        webp.put_single_code(bits, (argb >> s) & 255)
    webp.put_single_code(bits, 0)


def test_palette():
    bits = _head(4, 1)
    bits.put(1, 1), bits.put(3, 2), bits.put(1, 8)  # two colours, eight pixels in one
    bits.put(0, 1)
    _two(bits, 10, 20)  # green of the palette: 10, then plus 20
    webp.put_single_code(bits, 1), webp.put_single_code(bits, 2), webp.put_single_code(bits, 255), webp.put_single_code(bits, 0)
    bits.put(0, 1), bits.put(1, 1)
    bits.put(0, 1)  # no more transforms
    _constant_image(bits, 0b0110 << 8, meta=True)
    assert webp.decode(webp.riff(bits.bytes()))[0].tolist() == [[1, 10, 2, 255], [2, 30, 4, 254], [2, 30, 4, 254], [1, 10, 2, 255]]


@pytest.mark.parametrize("mode", range(14))
def test_predictors_against_plain_python(mode):
    rng = np.random.default_rng(mode)
    res = rng.integers(0, 256, (5, 6, 4))
    argb = webp._joined(res)
    got = webp._channels(webp._unpredict(argb, np.full((2, 2), mode), 2))
    want = np.zeros((5, 6, 4), int)
    avg = lambda a, b: (a + b) // 2
    for y in range(5):
        for x in range(6):
            if x == y == 0:
                p = np.array([255, 0, 0, 0])
            elif y == 0:
                p = want[0, x - 1]
            elif x == 0:
                p = want[y - 1, 0]
            else:
                left, top, tl = want[y, x - 1], want[y - 1, x], want[y - 1, x - 1]
                tr = want[y - 1, x + 1] if x < 5 else want[y, 0]
                full = left + top - tl
                half = avg(left, top)
                p = [
                    np.array([255, 0, 0, 0]), left, top, tr, tl, avg(avg(left, tr), top), avg(left, tl), avg(left, top), avg(tl, top), avg(top, tr), avg(avg(left, tl), avg(top, tr)),
                    left if np.abs(full - left).sum() < np.abs(full - top).sum() else top, np.clip(full, 0, 255), np.clip([int(h + int((h - t) / 2)) for h, t in zip(half, tl)], 0, 255),
                ][mode]
            want[y, x] = (res[y, x] + p) & 255
    assert (got == want).all()


def test_cross_colour_inverts():
    rng = np.random.default_rng(9)
    pixels, element = rng.integers(0, 256, (4, 4, 4)), 0xFF00FB07
    signed = lambda v: ((v & 255) ^ 128) - 128
    r2b, g2b, g2r = (signed((element >> s) & 255) for s in (16, 8, 0))
    green, red = signed(pixels[..., 2]), signed(pixels[..., 1])
    forward = pixels.copy()
    forward[..., 1] = (pixels[..., 1] - ((g2r * green) >> 5)) & 255
    forward[..., 3] = (pixels[..., 3] - ((g2b * green) >> 5) - ((r2b * red) >> 5)) & 255
    got = webp._channels(webp._uncross(webp._joined(forward), np.full((1, 1), element, np.uint32), 2))
    assert (got == pixels).all()


def test_back_reference_cache_and_subtracted_green():
    bits = _head(6, 1)
    bits.put(1, 1), bits.put(2, 2)  # subtract green
    bits.put(0, 1)
    bits.put(1, 1), bits.put(1, 4)  # a cache of two colours
    bits.put(0, 1)
    cache = lambda argb: ((argb * 0x1E35A7BD) & 0xFFFFFFFF) >> 31
    slot = 280 + cache(0xFF020503)
    # green code: literals 5 and 7, length prefix 256 + 1 and a cache entry, all of two bits
    lengths = [0] * 282
    for s in (5, 7, 257, slot):
        lengths[s] = 2
    bits.put(0, 1), bits.put(12 - 4, 4)
    own = {18: 2, 17: 2, 0: 2, 2: 2}
    for s in webp._LENGTH_ORDER[:12]:
        bits.put(own.get(s, 0), 3)
    bits.put(0, 1)
    # canonical codes of the lengths' code in the order 0, 2, 17, 18, written from the first bit
    code = {0: 0b00, 2: 0b10, 17: 0b01, 18: 0b11}
    at = 0
    while at < 282:
        if lengths[at]:
            bits.put(code[2], 2)
            at += 1
            continue
        run = next((k for k in range(at, 282) if lengths[k]), 282) - at
        if run >= 11:
            run = min(run, 138)
            bits.put(code[18], 2), bits.put(run - 11, 7)
        elif run >= 3:
            bits.put(code[17], 2), bits.put(run - 3, 3)
        else:
            run = 1
            bits.put(code[0], 2)
        at += run
    webp.put_single_code(bits, 2), webp.put_single_code(bits, 3), webp.put_single_code(bits, 255)
    webp.put_single_code(bits, 1)  # distance prefix 1: the code 2, the pixel to the left
    symbol = dict(zip(sorted((5, 7, 257, slot)), (0b00, 0b10, 0b01, 0b11)))
    for s in (5, 7, 257, slot, 7):
        bits.put(symbol[s], 2)
    got = webp.decode(webp.riff(bits.bytes()))[0].tolist()
    five, seven = [7, 5, 8, 255], [9, 7, 10, 255]
    assert got == [five, seven, seven, seven, five, seven]


@pytest.mark.parametrize("raw", [b"", b"RIFF", webp.riff(b"\x2f"), webp.riff(b"\x00" * 9), webp.encode(np.zeros((2, 16, 4), np.uint8))[:-40]])
def test_broken_files_are_told(raw):
    with pytest.raises(webp.WebpError):
        webp.decode(raw)


def _pictures():
    rng = np.random.default_rng(12)
    y, x = np.mgrid[0:70, 0:90]
    slope = np.stack([3 * x, 2 * y + x, x + y, np.full_like(x, 255)], axis=-1).astype(np.uint8)
    few = lambda n: rng.integers(0, 256, (n, 4)).astype(np.uint8)[rng.integers(0, n, (33, 21))]
    strips = np.tile(rng.integers(0, 256, (1, 90, 4)).astype(np.uint8), (70, 1, 1))
    return [slope, strips, rng.integers(0, 256, (9, 33, 4)).astype(np.uint8), *map(few, (1, 2, 3, 5, 16, 17, 256, 300)), np.full((5, 7), 9, np.uint8), rng.integers(97, 123, (64, 64)).astype(np.uint8), np.tile(rng.integers(0, 256, (1, 90)).astype(np.uint8), (70, 1)), rng.integers(0, 256, (1, 1)).astype(np.uint8), np.repeat(rng.integers(0, 256, (40, 9, 4)), 11, axis=1).astype(np.uint8)]


@pytest.mark.parametrize("number", range(16))
def test_pictures_come_back(number):
    picture = _pictures()[number]
    assert np.array_equal(webp.decode(webp.encode(picture)), picture)


def test_the_writer_uses_what_the_reader_undoes(monkeypatch):
    undone = collections.Counter()
    for name in ("_unpredict", "_uncross", "_unpalette", "_with_cache"):
        own = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, own=own, name=name: (undone.update([name]), own(*a))[1])
    numbers = webp._references
    monkeypatch.setattr(webp, "_references", lambda v: (undone.update(references=len(numbers(v)[0])), numbers(v))[1])
    for picture in _pictures():
        webp.decode(webp.encode(picture))
    assert all(undone[name] for name in ("_unpredict", "_uncross", "_unpalette", "_with_cache", "references")), undone


def test_long_streams_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(webp, "_CHUNK_BITS", 1 << 9)
    for picture in _pictures():
        assert np.array_equal(webp.decode(webp.encode(picture)), picture)


def test_crc_of_pieces():
    rows = packing._rows(packing._split(_window(5)), 0).to_pylist()
    assert [r["length"] for r in rows] == [4, 1] and rows[0]["ids_crc32"] == zlib.crc32(np.arange(4, dtype="<u4").tobytes())


def _window(n):
    w = packing._Window()
    w.add((1, 0, np.arange(n, dtype=np.uint32), n))
    return w
