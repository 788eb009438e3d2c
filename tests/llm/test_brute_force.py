"""Operators against plain versions of themselves on small fixtures."""

import math
import random
import string
import struct
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from tests.conftest import DATA
from tests.llm.test_operators import smith_waterman

import corpus_pipeline
from fathom.llm import decontaminate, gif_media, line_dedup, lm_score, mixing, near_dedup, secret_scan, substring_dedup, token_counts, toxicity


def words(text):
    return "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in text).split()


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def roots(pairs):
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for x in up}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            rate = rng.choice((0.01, 0.05, 0.1, 0.3))
            texts.append(" ".join(w if rng.random() > rate else f"edit{rng.random()}" for w in base))
    sets = list(map(shingles, texts))
    alike = {(i, k): jaccard(sets[i], sets[k]) for i in range(len(texts)) for k in range(i)}
    links, _ = near_dedup.near_duplicate_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = roots((r["a"], r["b"]) for r in links.collect())
    same = lambda i, k: got.get(i, i) == got.get(k, k)
    sure = [p for p, j in alike.items() if j >= 0.6]
    assert len(sure) > 20 and all(same(*p) for p in sure)
    near = [p for p, j in alike.items() if 0.5 <= j < 0.6]
    assert sum(same(*p) for p in near) >= 0.7 * len(near)
    assert all(alike[max(r["a"], r["b"]), min(r["a"], r["b"])] > 0.3 for r in links.collect())


def repeats(rows, least):
    """Occurrences of maximal repeats that no longer repeat of their document contains, by trying all passages."""
    seen = {}
    for i, text in rows:
        w = text.split()
        for a in range(len(w)):
            for b in range(a + least, len(w) + 1):
                c = seen.setdefault(tuple(w[a:b]), [0, None])
                c[0] += 1
                if i is not None and (c[1] is None or i < c[1]):
                    c[1] = i
    out = set()
    for i, text in rows:
        w, reach = text.split(), 0
        for a in range(len(w)):
            ends = [b for b in range(a + least, len(w) + 1) if seen[tuple(w[a:b])][0] > 1]
            if ends and ends[-1] > reach:
                reach = ends[-1]
                out.add((i, a, reach, *seen[tuple(w[a:reach])]))
    return out


def random_texts(rng, n):
    rows = []
    for d in range(n):
        w = []
        while len(w) < rng.randint(5, 60):
            u = rng.random()
            if u < 0.15:
                w += [rng.choice("xyz")] * rng.randint(1, 30)
            elif u < 0.5:
                w += rng.choices("ab", k=rng.randint(1, 9))
            elif rows and u < 0.8:
                old = rng.choice(rows)[1].split()
                a = rng.randint(0, len(old))
                w += old[a : a + rng.randint(0, 40)]
            else:
                w += rng.choices("abcdefgh", k=rng.randint(1, 9))
        rows.append((d if d % 7 else None, " ".join(w)))
    return rows + [rows[3], rows[3], (99, rows[5][1])]


@pytest.mark.parametrize(("first", "group", "n"), [(6, substring_dedup.GROUP, 40), (100, 2000, 14)])
def test_repeats_against_all_passages(spark, monkeypatch, first, group, n):
    monkeypatch.setattr(substring_dedup, "FIRST", first)
    monkeypatch.setattr(substring_dedup, "GROWTH", 2)
    rows = random_texts(random.Random(n), n)
    got = list(map(tuple, substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 8, 4, group).collect()))
    assert set(got) == repeats(rows, 8) and len(got) == len(set(got))


def test_repeats_have_their_own_copies(spark):
    rng = random.Random(1)
    base = [f"b{k}" for k in range(200)]
    other = lambda n: [f"c{rng.random()}" for _ in range(n)]
    rows = [(1, base), (2, base), (3, other(9) + base[20:80] + other(8)), (4, other(3) + base[100:170]), (5, base[60:110] + other(5))]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = set(map(tuple, substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == repeats(rows, 50) and (1, 0, 200, 2, 1) in got and (3, 9, 69, 3, 1) in got


def test_large_clusters_of_near_copies_are_not_split_by_edits(spark, monkeypatch):
    """30 copies of a text with an edit each: one partition in memory, whatever the length that is read."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for d in range(30):
        w = list(base)
        w[rng.randrange(20, 290)] = f"edit{d}"
        rows.append((d, " ".join(w)))
    names, cut = [], substring_dedup.cut
    monkeypatch.setattr(substring_dedup, "cut", lambda df, name: names.append(name) or cut(df, name))
    got = list(map(tuple, substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 8, 4, 4000).collect()))
    assert set(got) == repeats(rows, 8) and len(got) == len(set(got))
    assert names.count("parts") == 0


def test_repeats_write_no_table_of_all_anchors(spark, monkeypatch):
    names, cut = [], substring_dedup.cut
    monkeypatch.setattr(substring_dedup, "cut", lambda df, name: names.append(name) or cut(df, name))
    rows = [(d, " ".join(f"w{k}" for k in range(d, 60 + d))) for d in range(3)]
    assert set(map(tuple, substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 8, 4).collect())) == repeats(rows, 8)
    assert names[:2] == ["places", "held"]


def test_neighbours_agree_as_the_matrix_says(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 7)
    rng = np.random.default_rng(2)
    rows = sorted(b"".join(int(x).to_bytes(4, "big") for x in rng.choice([1, 2, (1 << 31) | 3, (1 << 31) | 5], rng.integers(0, 9))) for _ in range(200))
    values = pa.array([b"1234", *rows], pa.binary()).slice(1)
    k, s = np.arange(len(rows) - 1), substring_dedup.Symbols(values)
    size, at, words = substring_dedup.neighbours(values)
    assert (size == s.size).all() and all((x == y).all() for x, y in zip((at, words), s.common(k, k + 1)))


def test_lm_against_direct_model(spark):
    rng = random.Random(4)
    texts = [(k, "".join(rng.choices("abc é\n", k=rng.randint(0, 120)))) for k in range(60)] + [(5, "abcabc"), (5, "abcabc"), (None, "xyz"), (61, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    folds = [(r["doc_id"], r["text"], r["fold"]) for r in lm_score.folded(docs).collect()]
    counts = defaultdict(Counter)
    for _, text, fold in folds:
        raw = [0] * 4 + [b + 1 for b in (text or "").encode()]
        for k in range(4, len(raw)):
            counts[fold][tuple(raw[k - 4 : k + 1])] += 1
    every = sum(counts.values(), Counter())

    def tables(fold):
        n, m = Counter(), Counter()
        for gram, c in every.items():
            for k in range(1, 6):
                n[gram[-k:]] += c - counts[fold][gram]
                m[k, gram[5 - k : 4]] += c - counts[fold][gram]
        return n, m

    known = [tables(f) for f in range(4)]

    def parts(gram, fold):
        n, m = known[fold]
        seen = m[5, gram[:4]]
        each = [1 / 256] + [n[gram[-k:]] / m[k, gram[5 - k : 4]] if m[k, gram[5 - k : 4]] else 0 for k in range(1, 6)]
        return (math.floor(math.log2(seen + 0.5)) + 1 if seen else 0), each

    weights = defaultdict(lambda: [1 / 6] * 6)
    for _ in range(lm_score.ROUNDS):
        sums = defaultdict(lambda: [0.0] * 6)
        for gram, c in counts[0].items():
            b, each = parts(gram, 0)
            p = [w * e for w, e in zip(weights[b], each)]
            for k in range(6):
                sums[b][k] += c * p[k] / sum(p)
        for b, w in sums.items():
            w = [x / sum(w) for x in w]
            w[0] = max(w[0], lm_score.LEAST)
            weights[b] = [x / sum(w) for x in w]
    want = Counter()
    for i, text, fold in folds:
        raw, total = [0] * 4 + [b + 1 for b in (text or "").encode()], 0.0
        for k in range(4, len(raw)):
            b, each = parts(tuple(raw[k - 4 : k + 1]), fold)
            total += math.log(sum(w * e for w, e in zip(weights[b], each)))
        want[i, len(raw) - 4, round(total, 2)] += 1
    for block in (lm_score.BLOCK, 200):
        got = Counter((r["doc_id"], r["bytes"], round(r["log_prob"], 2)) for r in lm_score.lm_scores(docs, block).collect())
        assert sum((got & want).values()) >= len(texts) - 1  # one may fall on a rounding edge


def plain_lzw(data, least, most):
    """Code by code."""
    clear, out, bits, have, at = 1 << least, bytearray(), 0, 0, 0
    table, width, last = {}, least + 1, None
    while len(out) < most:
        while have < width:
            if at >= len(data):
                return bytes(out)
            bits, have, at = bits | data[at] << have, have + 8, at + 1
        code, bits, have = bits & ((1 << width) - 1), bits >> width, have - width
        if code == clear:
            table, width, last = {k: bytes([k]) for k in range(clear)} | {clear: b"", clear + 1: b""}, least + 1, None
            continue
        if code == clear + 1:
            break
        entry = table[code] if code in table else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table[len(table)] = last + entry[:1]
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry
    return bytes(out[:most])


def plain_frames(data):
    """(start, delay, disposal, canvas) pixel by pixel."""
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        shared, at = data[at : at + n], at + n
    canvas, clock, control = [(0, 0, 0, 0)] * (width * height), 0, (0, 0, -1)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label, at, body = data[at + 1], at + 2, b""
            while data[at]:
                body, at = body + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
            at += 1
            if label == 0xF9:
                control = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0] * 10, body[3] if body[0] & 1 else -1
            continue
        x, y, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at, palette = at + 10, shared
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            palette, at = data[at : at + n], at + n
        least, at, body = data[at], at + 1, b""
        while data[at]:
            body, at = body + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        at += 1
        pixels = plain_lzw(body, least, w * h)
        order = [r for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, b)] if flags & 0x40 else range(h)
        before = list(canvas)
        for k, row in enumerate(order):
            for col in range(w):
                p = pixels[k * w + col]
                if p != control[2] and row + y < height and col + x < width:
                    canvas[(row + y) * width + col + x] = (*palette[3 * p : 3 * p + 3], 255)
        yield clock, control[1], control[0], bytes(v for p in canvas for v in p)
        if control[0] == 2:
            for row in range(y, min(height, y + h)):
                for col in range(x, min(width, x + w)):
                    canvas[row * width + col] = (0, 0, 0, 0)
        elif control[0] == 3:
            canvas = before
        clock, control = clock + control[1], (0, 0, -1)


def hand_made():
    """Four colours, 4 by 3: a full frame, then small ones of each disposal, with transparency, a local palette and interlacing."""
    red, other = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9]), bytes([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])
    out = b"GIF89a" + struct.pack("<HHBBB", 4, 3, 0x81, 0, 0) + red
    frames = [(1, 5, -1, 0, 0, 4, 3, None, 0), (2, 7, 1, 1, 1, 2, 2, None, 0), (3, 1, -1, 0, 0, 2, 3, other, 1), (0, 0, 2, 2, 1, 2, 2, None, 0), (1, 9, -1, 3, 2, 3, 3, other, 1)]
    for k, (disposal, delay, clear, x, y, w, h, palette, interlaced) in enumerate(frames):
        pixels = bytes((k + 3 * i) % 4 for i in range(w * h))
        body = gif_media.lzw_encode(pixels, 2)
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear >= 0), delay, max(clear, 0), 0)
        out += struct.pack("<BHHHHB", 0x2C, x, y, w, h, (0x81 if palette else 0) | 0x40 * interlaced) + (palette or b"") + b"\x02" + bytes([len(body)]) + body + b"\0"
    return out + b";"


def test_gif_against_plain_decoder():
    rng = np.random.default_rng(2)
    files = [hand_made(), gif_media.encode(b""), *(gif_media.encode(bytes(rng.integers(0, k, n, dtype=np.uint8))) for k, n in ((4, 30_000), (256, 9000), (100, 64)))]
    for data in files:
        got, want = list(gif_media.frames(data)), list(plain_frames(data))
        assert [(f["start_ms"], f["delay_ms"], f["disposal"], f["rgba"]) for f in got] == want
        for f in got:
            pixels = np.frombuffer(f["rgba"], np.uint8).reshape(-1, 4)
            seen = Counter((int(r) >> 6) << 4 | (int(g) >> 6) << 2 | int(b) >> 6 for r, g, b, a in pixels if a == 255)
            assert f["histogram"] == [seen[k] for k in range(64)] and f["opaque"] == sum(seen.values())
    known = b"\x8c\x2d\x99\x87\x2a\x1c\xdc\x33\xa0\x02\x75\xec\x95\xfa\xa8\xde\x60\x8c\x04\x91\x4c\x01"  # a well-known 10 by 10 sample
    assert gif_media.lzw_decode(known, 2, 100).tobytes() == plain_lzw(known, 2, 100) and len(plain_lzw(known, 2, 100)) == 100


def test_gif_broken_files(spark):
    whole = hand_made()
    rows = [(0, None), (1, b""), (2, b"GIF89a"), (3, whole[:-1]), (4, whole[:60]), (5, b"PNG" + whole), (6, whole)]
    got = defaultdict(list)
    for r in gif_media.gif_frames(spark.createDataFrame(rows, "k long, m binary"), "k", "m").collect():
        got[r["k"]].append(r["error"])
    assert 0 not in got and got[1] == got[2] == got[5] == ["not a GIF"] and got[3] == [None] * 5 + ["the trailer is missing"] and got[6] == [None] * 5 and got[4][-1] and len(got[4]) < 5
    small = gif_media.gif_frames(spark.createDataFrame([(6, whole)], "k long, m binary"), "k", "m", most_pixels=11).collect()
    assert [r["error"] for r in small] == ["a canvas of this size isn't decoded"]


def test_tokens_against_one_merge_at_a_time():
    merges = token_counts.load_merges(token_counts.VOCABULARY)
    known = dict(zip(merges["keys"].tolist(), merges["merged"].tolist()))

    def plain(raw):
        s = [int(merges["bytes"][b]) for b in raw]
        while True:
            ranks = [(known[a << 20 | b], k) for k, (a, b) in enumerate(zip(s, s[1:])) if a << 20 | b in known]
            if not ranks:
                return len(s)
            r, k = min(ranks)
            s[k : k + 2] = [r]

    rng = random.Random(6)
    raw = [bytes(rng.choices(alphabet, k=rng.randint(1, 90))) for alphabet in (b"a", b"ab ", b"etaoin", bytes(range(256)), b" \n") for _ in range(40)] + [b"aaaa" * 80, b"x"]
    assert token_counts.count_symbols(merges, raw).tolist() == [plain(x) for x in raw]
    assert token_counts.count_symbols(merges, []).tolist() == []


def test_toxicity_gradients():
    rng = np.random.default_rng(8)
    model = {k: v.astype(np.float64) for k, v in toxicity.new_model(3).items()}
    x, index = rng.normal(size=(9, toxicity.WORD_DIM + toxicity.CHAR_DIM)), rng.integers(-1, 9, (5, toxicity.WINDOW))
    index[:, 0] = 0
    slope = rng.normal(size=5)
    loss = lambda: float(toxicity.forward(model, x, index) @ slope)
    _, saved = toxicity.forward(model, x, index, keep=True)
    grad, d_x = toxicity.backward(model, x, index, saved, slope)
    for name, value in [(k, model[k]) for k in grad] + [("x", x)]:
        mine = d_x if name == "x" else grad[name]
        for at in {tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)}:
            old = value[at]
            value[at] = old + 1e-2
            high = loss()
            value[at] = old - 1e-2
            low = loss()
            value[at] = old
            assert abs((high - low) / 2e-2 - mine[at]) < 2e-2 * max(1.0, abs(mine[at])), (name, at)


def test_toxicity_ties_go_to_the_first_window():
    model = toxicity.new_model()
    same = " ".join(["word"] * 100)
    s = toxicity.score_texts(model, pa.array([same, same + " word", None]))
    assert s.field("worst_word").to_pylist()[2] == -1 and s.field("windows").to_pylist() == [8, 8, 0]
    scores = [toxicity.score_texts(model, pa.array([" ".join(["word"] * 24)])).field("score")[0].as_py()]
    assert s.field("worst_word").to_pylist()[:2] == [0, 0] and abs(s.field("score")[0].as_py() - scores[0]) < 1e-6


def test_toxicity_trains_on_all_labelled_documents(spark):
    """More of each class than any fixed sample, and long texts: each labelled document once, whole."""
    rows = [(k, f"text number {k} here") for k in range(5000)] + [(5000 + k, "word " * 4000 + str(k)) for k in range(40)] + [(7, "text number 7 here"), (None, "x"), (9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(5030)] + [(1, 1), (9000, 1), (9001, 0), (9999, 1), (None, 1), (5035, None)], "doc_id long, toxic int")
    texts, toxic = toxicity.training_sample(docs, labels)
    want = {k: k % 3 == 0 for k in range(5030) if k != 1}  # 1 has both labels
    text_of = dict(rows)
    assert sorted(zip(texts, toxic)) == sorted((text_of[k], t) for k, t in want.items())


def test_toxicity_by_the_cluster_is_that_of_one_process(spark, monkeypatch):
    """Several blocks, each with documents of over 10,000 characters, where alone the toxic words are."""
    monkeypatch.setattr(toxicity, "BLOCK", 200_000)
    monkeypatch.setattr(toxicity, "LEAST_WINDOWS", 40_000)
    rng = random.Random(4)
    words, bad = [f"w{k}" for k in range(300)], [f"vile{k}" for k in range(6)]
    rows = []
    for k in range(120):
        text = rng.choices(words, k=2800 if k % 4 < 2 else 60)
        if k % 4 == 0:
            text[1000:1000] = rng.choices(bad, k=10)
        rows.append((k, " ".join(text), int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(7)
    ordered, blocks = toxicity.labelled(docs, docs)
    parts = defaultdict(list)
    for r in ordered.collect():
        parts[r["block"]].append((r["text"], r["toxic"]))
    assert blocks > 1 and sum(map(len, parts.values())) == len(rows)
    one = toxicity.train_blocks([toxicity.packed(toxicity.tokenised(*map(list, zip(*parts[k])))) for k in sorted(parts)])
    all_ = toxicity.train_on(docs, docs)
    assert all(np.array_equal(one[k], all_[k]) for k in one)
    got = {r["doc_id"] for r in toxicity.toxicity(docs, docs).collect() if r["toxic"]}
    want = {k for k, _, toxic in rows if toxic}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def test_toxicity_rounds():
    """Each pass visits each block, and no round visits one twice."""
    for blocks, passes in ((1, 3), (2, 2), (5, 3), (100, 1)):
        done = list(toxicity.rounds(blocks, passes))
        assert sorted(k for r in done for _, k in r) == sorted(list(range(blocks)) * passes)
        assert all(len({k for _, k in r}) == len(r) for r in done) and [q for r in done for q, _ in r] == list(range(blocks * passes))


def test_secrets_of_a_labelled_set(spark):
    rng = random.Random(3)
    pick = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    plain, symbols = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "!#$%&*@^"
    secret = [pick("0123456789abcdef", n) for n in (16, 24, 32, 40, 64) for _ in range(8)] + [pick(plain, n) for n in (12, 16, 20, 32, 40) for _ in range(8)] + [pick(symbols, n) for n in (10, 12, 16) for _ in range(8)] + ["hunter2Xq9", "Tr0ub4dor&3xK"]
    known = [w for w in secret_scan.CODE.decode().split() if w.isalpha() and w.islower() and 4 <= len(w) <= 13]
    own = ["blorvak", "quemista", "zhandor", "fintrelop"]  # words of the texts alone
    camel = lambda p: p[0] + "".join(w.title() for w in p[1:])
    clean = [camel(rng.sample(known, k)) for k in (2, 3, 4, 5) for _ in range(8)] + ["_".join(rng.sample(known, k)) for k in (3, 4) for _ in range(8)] + [camel(rng.sample(own, 3)) for _ in range(4)]
    clean += ["getAccessTokenFromConfigurationService", "correcthorsebatterystaple", "changeme", "your-token-here", "xxxxxxxxxxxxxxxx", "process.env.API_TOKEN", "${SECRET}"]
    texts = [f"here the client reads its settings. {rng.choice(('api_key', 'dbPassword', 'token'))} = '{v}' and then it goes on" for v in secret + clean] + [" ".join(own)] * 50
    got = {r["doc_id"] for r in secret_scan.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    recall, wrong = sum(k in got for k in range(len(secret))) / len(secret), sum(k >= len(secret) for k in got) / len(clean)
    print(f"secrets: recall {recall:.3f}, clean reported {wrong:.3f}", [clean[k - len(secret)] for k in got if len(secret) <= k < len(secret) + len(clean)])
    assert recall >= 0.97 and wrong <= 0.06


def test_mixing_ties(spark):
    """Documents of one id share a place: both go or both stay."""
    rows = [(k // 2, "a b c", "s" if k < 60 else "t") for k in range(80)] + [(None, "a", "s"), (900, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["source"]) for r in mixing.mix_sources(docs, {"s": 1.0, "t": 1.0}).collect())
    place = lambda i: int(md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)
    want = Counter()
    for source in "st":
        own = sorted((r for r in rows if r[2] == source), key=lambda r: place(r[0]))
        for r in own:
            if sum(len((x[1] or "").split()) for x in own if place(x[0]) <= place(r[0])) <= 60:
                want[r[0], source] += 1
    assert got == want


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts, toxic = toxicity.training_sample(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    model = toxicity.train(texts, toxic)
    rows = [r.asDict() for r in docs.collect()]
    least = toxicity._sigmoid(np.float64(model["threshold"]))
    scores = toxicity.score_texts(model, pa.array([r["text"] for r in rows])).field("score").to_pylist()
    rows = [r for r, s in zip(rows, scores) if s < least]
    clean = lambda line: " ".join(line.lower().replace("\t", " ").replace("\r", " ").split(" ")).strip()
    squeeze = lambda line: " ".join(clean(line).split())
    where = defaultdict(set)
    for r in rows:
        for line in r["text"].split("\n"):
            where[squeeze(line)].add(r["doc_id"])
    common = {k for k, d in where.items() if k and len(d) > line_dedup.MAX_DOCUMENTS}
    for r in rows:
        r["text"] = "\n".join(x for x in r["text"].split("\n") if squeeze(x) not in common)
    sets = [shingles(r["text"]) for r in rows]
    alike = {(i, k): jaccard(sets[i], sets[k]) for i in range(len(rows)) for k in range(i)}
    doubtful = {rows[x]["doc_id"] for p, j in alike.items() if 0.35 < j < 0.6 for x in p}
    up = roots((rows[i]["doc_id"], rows[k]["doc_id"]) for (i, k), j in alike.items() if j >= 0.5)
    rows = [r for r in rows if up.get(r["doc_id"], r["doc_id"]) == r["doc_id"]]
    items = [words(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in items]
    kept = []
    for r in rows:
        w = words(r["text"])
        own = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        if not any(own & g and smith_waterman(w, item) >= decontaminate.THRESHOLD for g, item in zip(grams, items)):
            kept.append(r)
    have = Counter()
    for r in kept:
        have[r["source"]] += len(r["text"].split())
    weights = {s: w for s, w in mixing.WEIGHTS.items() if s in have}
    whole = sum(weights.values())
    total = min(have[s] * whole / w for s, w in weights.items() if have[s])
    want = set()
    for s, w in weights.items():
        used = 0
        for r in sorted((r for r in kept if r["source"] == s), key=lambda r: md5(str(r["doc_id"]).encode()).hexdigest()[:15]):
            used += len(r["text"].split())
            if used > math.floor(total * w / whole + 1e-6):
                break
            want.add((r["doc_id"], r["text"]))
    assert not doubtful, doubtful
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, DATA).collect()} == want and want


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeated rows and an empty table in every stage."""
    rows = [(1, "one two three four", "en", "src0", 18), (None, None, None, None, None), (2, "", "en", None, 0), (1, "one two three four", "en", "src0", 18), (3, "five six\nseven", "en", "src1", 14)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    for name, own in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(own, shape).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "nine ten")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == shape.replace(" long", "").replace(" string", "").split(", ")
        kept = sorted(str(r["doc_id"]) for r in docs.collect())
        assert kept == (["1", "2", "3", "None"] if own else [])
        assert corpus_pipeline.run(spark, folder).count() <= 2


def test_toxicity_learns_later_blocks_once_and_scores_them_before(monkeypatch):
    """Beyond the first LEAST_WINDOWS windows each window is learnt from once, after its text's score for the threshold, which all texts give; a word that only later blocks have is learnt too."""
    monkeypatch.setattr(toxicity, "BLOCK", 100_000)
    monkeypatch.setattr(toxicity, "LEAST_WINDOWS", 5000)
    monkeypatch.setattr(toxicity, "LEARN_BATCH", 16)
    rng = np.random.default_rng(4)
    calm, bad = [f"calm{k}" for k in range(400)], ["vile", "rotten", "filthy"]
    words, labels = [], []
    for k in range(3600):
        text = list(rng.choice(calm, 60))
        labels.append(k % 4 == 0)
        for at in rng.integers(0, 60, 6) if labels[-1] else ():
            text[at] = "nasty" if k > 2400 and k % 3 == 0 else rng.choice(bad)
        words.append(" ".join(text))
    learn, threshold, learnt, scores = toxicity._learn, toxicity._threshold, [], []
    monkeypatch.setattr(toxicity, "_learn", lambda block, model, frequent, positive, negative, seed: learnt.append((block, positive, negative, seed)) or learn(block, model, frequent, positive, negative, seed))
    monkeypatch.setattr(toxicity, "_threshold", lambda best, truth: scores.append((len(best), int(truth.sum()))) or threshold(best, truth))
    model = toxicity.train(words, np.array(labels))
    assert scores == [(3600, 900)]
    by_text = {}
    for block, positive, negative, _ in learnt:
        by_text.setdefault(block.windows.tobytes(), []).append((block, positive, negative))
    once = [v[0] for v in by_text.values() if len(v) == 1]
    assert len(by_text) > 14 and len(once) >= len(by_text) - 8
    for block, positive, negative in once:
        assert np.array_equal(negative, np.flatnonzero(~block.toxic)) and block.toxic[positive].all()
        assert set(block.text[positive]) == set(np.flatnonzero(block.label))  # of each toxic text at least the highest
    least = toxicity._sigmoid(np.float64(model["threshold"]))
    for word, toxic in (("rotten", True), ("nasty", True), ("calm3", False)):
        text = " ".join(word if j % 9 == 4 else c for j, c in enumerate(rng.choice(calm, 60)))
        assert (toxicity.score_texts(model, pa.array([text])).field("score")[0].as_py() >= least) == toxic, word
