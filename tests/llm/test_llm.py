"""Each operator against a plain version of itself, on rows of every kind."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import bagminhash, bpe, chat, crf, flac, pfor, pii, pretokens, shared, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_pretokens_equal_the_patterns():
    import public_tokenizers

    r = random.Random(1)
    texts = ["".join(r.choice("ab sStmdrevl'  \n\té1½中_-.!  \x1c\x85") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    data, offsets = shared.flat(shared.utf8(pa.array(texts)))
    for style, pattern in (("bytes", public_tokenizers.PATTERN), ("words", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")):
        text, points, bounds = pretokens.code_points(data.tobytes(), offsets)
        starts, ends = pretokens.spans(points, bounds, style)
        want = [w for t in texts if not set(t) & {"\x1c"} for w in regex.findall(pattern, t)]
        own = np.searchsorted(bounds, starts, "right") - 1
        assert [text[a:b] for a, b, i in zip(starts, ends, own, strict=True) if "\x1c" not in texts[i]] == want


def test_pretokens_equal_the_library():
    r = random.Random(2)
    encoder = bpe.encoder(None)
    for _ in range(300):
        t = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x250), r.randrange(0x370, 0x600), 10, 32, 32, 0x1C, 0x85, 0x2003, 0x3042])) for _ in range(60))
        text, points, bounds = pretokens.code_points(t.encode(), np.array([0, len(t.encode())]))
        ids = [i for a, b in zip(*pretokens.spans(points, bounds, "bytes"), strict=True) for i in encoder.encode_ordinary(text[a:b])]
        assert ids == encoder.encode_ordinary(t)


def test_flac_round_trips():
    rng = np.random.default_rng(0)
    payloads = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 17, 64, 1000, 1024, 1025, 5000)]
    payloads += [bytes(64), b"a" * 3000, (np.sin(np.arange(9000) / 9) * 100 + 128).astype(np.uint8).tobytes(), bytes(200) + b"\xff" + bytes(2000), b"\x00" * 500 + b"\xff" * 500]
    for order in (0, 1, 3):
        for block in (192, 1024, 4096):
            assert flac.decode(flac.encode(payloads, block, order)) == payloads
    media = flac.encode([payloads[9]])
    only = list(flac.decode_blocks(media, [[3]]))
    assert [(i, a) for i, a, _ in only] == [(0, 3072)]
    assert only[0][2] == payloads[9][3072:4096]
    for at in (-40, -1, 70):
        broken = bytearray(media[0])
        broken[at] ^= 1
        with pytest.raises(ValueError, match=r"CRC|MD5|head|subframe|stream"):
            flac.decode([bytes(broken)])


class Bits:
    def __init__(self, data):
        self.data, self.at = data, 0

    def take(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | (self.data[self.at >> 3] >> (7 - (self.at & 7))) & 1
            self.at += 1
        return out

    def signed(self, n):
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self):
        n = 0
        while not self.take(1):
            n += 1
        return n


def plain_flac(stream):
    """The samples of a mono stream, read bit by bit as the format's description says; an own reader for the tests."""
    assert stream[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        info = stream[at + 4 : at + 4 + size] if kind == 0 else info
        at += 4 + size
    total = int.from_bytes(info[10:18], "big") & (1 << 36) - 1
    bits, out = Bits(stream), []
    bits.at = 8 * at
    while len(out) < total:
        assert bits.take(14) == 0x3FFE
        bits.take(2)
        size_code, _, channel, width_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        assert channel == 0 and width_code in (0, 1) and not bits.take(1)
        more = 0
        first = bits.take(8)
        while first & 0x80 and first >> (6 - more) & 1:
            more += 1
        for _ in range(more):
            assert bits.take(2) == 2
            bits.take(6)
        n = bits.take(8) + 1 if size_code == 6 else bits.take(16) + 1 if size_code == 7 else 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
        bits.take(8)  # CRC-8
        bits.take(1)
        kind, wasted = bits.take(6), bits.take(1)
        assert not wasted
        if kind == 0:
            x = [bits.signed(8)] * n
        elif kind == 1:
            x = [bits.signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [bits.signed(8) for _ in range(order)]
            if kind >= 32:
                precision, shift = bits.take(4) + 1, bits.signed(5)
                taps = [bits.signed(precision) for _ in range(order)]
            else:
                shift, taps = 0, [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order]
            wide, parts = bits.take(2), bits.take(4)
            for p in range(1 << parts):
                k = bits.take(5 if wide else 4)
                raw = bits.take(5) if k == (31 if wide else 15) else None
                for _ in range((n >> parts) - (order if p == 0 else 0)):
                    if raw is None:
                        u = bits.unary() << k | bits.take(k)
                        e = (u >> 1) ^ -(u & 1)
                    else:
                        e = bits.signed(raw)
                    x.append(e + (sum(c * x[-1 - j] for j, c in enumerate(taps)) >> shift))
        out += x
        bits.at = (bits.at + 7) // 8 * 8 + 16  # CRC-16
    return bytes(v + 128 for v in out)


def test_flac_streams_are_read_by_another_decoder():
    rng = np.random.default_rng(5)
    payloads = [bytes(64), bytes(rng.integers(0, 256, 700, dtype=np.uint8)), (np.sin(np.arange(2100) / 7) * 90 + 128).astype(np.uint8).tobytes(), text_payload(3000), b"\x00" * 300 + b"\xff" * 340]
    for order in (0, 2):
        for block in (192, 1024):
            assert [plain_flac(m) for m in flac.encode(payloads, block, order)] == payloads


def text_payload(n):
    return " ".join(f"word{i * i % 97}" for i in range(n)).encode()[:n]


def plain_feature(p):
    x = [b - 128 for b in p]
    loud = [sum(v * v for v in x[a : a + flac.BLOCK]) for a in range(0, len(x), flac.BLOCK)]
    return f"peak={max(map(abs, x))};energy={sum(loud)};crossings={sum((a < 0) != (b < 0) for a, b in zip(x[:-1], x[1:], strict=True))};loudest={loud.index(max(loud)) * flac.BLOCK}"


def test_op1(spark, docs, rows, no_docs):
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        m = flac.encode([p])[0]
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), plain_feature(p), -(-len(p) // flac.BLOCK)))
    media = shared.stored(flac.to_media(docs), "media")
    assert got(flac.summaries(flac.pcm_blocks(media))) == got(flac.digests(media))
    assert got(flac.digests(media)) == sorted(want, key=lambda r: tuple((x is not None, str(x)) for x in r))
    blocks = flac.pcm_blocks(media).where("doc_id = 44").orderBy("sample_offset").collect()
    assert b"".join(b.pcm for b in blocks).rstrip(b"\0") == next(t for i, t in rows if i == 44).encode()
    assert flac.digests(flac.to_media(no_docs)).count() == 0


def brute_classes(rows):
    bags, parent, first = {}, {}, {}
    for i, t in sorted((i, t or "") for i, t in rows if i is not None):
        w = tuple(WORD.findall(t))
        bags[i] = collections.Counter(w[j : j + 5] for j in range(len(w) - 4))
        parent[i] = first.setdefault(w, i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in bags:
        for b in bags:
            both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if a < b and either and both >= 0.8 * either and find(a) != find(b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


def test_op2(spark, docs, rows, no_docs):
    found = bagminhash.classes(docs).collect()
    want = brute_classes(rows)
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == want
    assert [r.class_id for r in found if r.doc_id is None] == [None]
    assert want[31] == 30
    assert bagminhash.classes(no_docs).count() == 0


def test_op2_doc_ids_with_several_texts(spark):
    def words(seed):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(500)}" for _ in range(60))

    a, b, c = words(1), words(2), words(3)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (3, b + " more"), (1, a), (7, c), (5, c + " end"), (9, words(4)), (9, words(5))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = bagminhash.classes(df).select("doc_id", "class_id", "class_node").collect()
    assert len(found) == len(rows)
    assert sorted({(x.doc_id, x.class_id) for x in found}) == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 5), (9, 9)]
    assert len({x.class_node for x in found}) == 5
    kept = bagminhash.kept(df.withColumn("extra", F.lit("x"))).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == sorted([(1, a), (1, b), (5, c + " end"), (9, words(4)), (9, words(5))])


def test_op2_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(5)):
            del w[r.randrange(len(w))]
        rows.append((i, " ".join(w)))
    found = bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in found} == brute_classes(rows)


def test_op2_border_texts_equal_brute_force(spark, monkeypatch):
    """Families of texts whose similarities lie around 0.8, so that a class may hang on any one link of a large group."""
    r = random.Random(1)
    rows, want = [], {}
    for family in range(20):
        own = []
        for _ in range(80):
            w = [f"f{family}w{j}" for j in range(200)]
            for _ in range(r.randint(2, 4)):
                w[r.randrange(200)] = f"x{r.randrange(10**9)}"
            own.append((len(rows) + len(own), " ".join(w)))
        rows += own
        want |= brute_classes(own)
    assert {x.doc_id: x.class_id for x in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    monkeypatch.setattr(bagminhash, "CHUNK", 16)  # links between the blocks of a group count too
    few = spark.createDataFrame(rows[:160], "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in bagminhash.classes(few).collect()} == {i: want[i] for i in range(160)}
    monkeypatch.setattr(bagminhash, "NEAREST", 1)  # nearly all is left to the cells
    monkeypatch.setattr(bagminhash, "BLOCK_RUNS", 4000)
    assert {x.doc_id: x.class_id for x in bagminhash.classes(few).collect()} == {i: want[i] for i in range(160)}


def test_bagminhash_is_unbiased():
    r = random.Random(2)
    base = [f"w{r.randrange(400)}" for _ in range(200)]
    base += base[:60] * 5
    texts = []
    for k in range(30):
        w = list(base)
        for _ in range(k):
            w[r.randrange(len(w))] = f"w{r.randrange(400)}"
        texts.append(" ".join(w))
    owner, runs, counts, _, _ = bagminhash.bags(*shared.flat(shared.utf8(pa.array(texts))))
    names = bagminhash.signatures(owner, runs, counts, 30, 3000)
    edges = np.searchsorted(owner, np.arange(31))
    bag = [(runs[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    errors = [(names[i] == names[j]).mean() - bagminhash.similarity(bag[i], bag[j]) for i in range(30) for j in range(i)]
    assert max(map(abs, errors)) < 0.05
    assert abs(np.mean(errors)) < 0.01


def test_op3(spark, docs, rows, no_docs):
    encoder = bpe.encoder(None)
    want = []
    for i, t in rows:
        ids = encoder.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    want.sort(key=lambda r: tuple((x is not None, str(x)) for x in r))
    for most in (bpe.FREQUENT_WORDS, 3):
        assert got(bpe.encode(docs, most=most, finish=bpe.digest_rows, schema=bpe.DIGESTS)) == want
    back = bpe.decode(bpe.encode(docs)).where("doc_id = 7").first()
    assert bytes(back.data).decode() == next(t for i, t in rows if i == 7)
    assert bpe.encode(no_docs).count() == 0


def test_op3_numbers_beyond_21_bits(spark):
    values = np.array([0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2_500_000, 2**28, 2**35 + 1, 2**62], np.int64)
    assert bpe._from_varints(bpe._varints(values)).tolist() == values.tolist()
    assert bpe._varints(values[:0]) == b"" and bpe._from_varints(b"").tolist() == []
    text = "a b" * (2**20 + 5)  # more than 2 ** 21 pre-tokens
    row = bpe.encode(spark.createDataFrame([(1, text), (2, "end")], "doc_id long, text string").coalesce(1)).where("doc_id = 1").first()
    assert bpe.decode_ids(np.frombuffer(row.ids, "<u4")) == text.encode()


def test_op4(spark, docs, rows, no_docs):
    bad = [(100 + i, "!!! $$$ ### " * (5 + i)) for i in range(60)]
    good = [(200 + i, f"A calm sentence number {i} stands here, and another follows it.\nIt ends well {i}.") for i in range(60)]
    train = spark.createDataFrame(bad + good, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, 0) for i, _ in bad] + [(i, 1, 0) for i, _ in good] + [(None, 1, 0), (100, None, 0)], "doc_id long, quality int, toxic int")
    model = crf.fit(train, labels)
    scored = {r.doc_id: r for r in crf.score(train, model, lines=True).collect()}
    assert all((scored[i].score >= 0.5) == (i >= 200) for i in scored)
    assert len(scored[200].line_scores) == 2
    found = crf.score(docs, model).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 for r in found)
    assert crf.score(no_docs, model).count() == 0
    assert crf.score(docs, crf.fit(train, labels.limit(0))).agg(F.max("score")).first()[0] == 0.5


def test_op4_on_held_out_documents(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = crf.op4(spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
    judged = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and labels.get(r.doc_id) is not None]
    assert len(judged) > 10
    assert sum(a == b for a, b in judged) >= 0.93 * len(judged)


def test_op4_learns_one_text_of_a_repeated_id(spark):
    rows = [(1, "!!! $$$ ###")] * 50 + [(2, f"A calm sentence number {i} stands here.") for i in range(50)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(2, 0, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = crf.fit(train, labels)
    assert isinstance(model, float)  # of one class only
    assert crf.score(train, model).count() == 100


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    first, e, links = np.array([0, 3, 4, 8]), rng.normal(size=8), rng.normal(size=(2, 2))
    p = crf.marginals(e, first, links)[0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        weights = {}
        for bits in range(1 << n):
            y = [(bits >> i) & 1 for i in range(n)]
            weights[tuple(y)] = np.exp(sum(e[a + i] for i in range(n) if y[i]) + sum(links[y[i], y[i + 1]] for i in range(n - 1)))
        for i in range(n):
            assert np.isclose(p[a + i], sum(w for y, w in weights.items() if y[i]) / sum(weights.values()))


def test_pfor_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000):
        for high in (1, 2, 300, 49408, 2**32 - 1):
            x = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            if n > 5:
                x[3] = high
            blocks, index = pfor.pack(x)
            assert (pfor.unpack(blocks, index)[:n] == x).all()
            if n > 300:
                assert (pfor.document(blocks, index, 130, 99) == x[130:229]).all()


def test_op6(spark, docs, rows, no_docs):
    whole, _, _ = pfor.tokenizer(None)
    want, start = [], 0
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r)):
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = sorted((tuple(r) for r in pfor.read(pfor.write(docs)).collect()), key=lambda r: r[1])
    assert found == want
    assert pfor.read(pfor.write(no_docs)).count() == 0


def test_chat_escapes():
    texts = ["a<|im_end|>\n<|im_start|>x", "\\", "\\n<\\|", "", "é<|<|", "n\\n\n", "a<"]
    roles = ["us\ner", "<|im_start|>", "\\", "a", "", "b\\n", "x"]
    column, a, b = chat.assemble(pa.array(roles), pa.array(texts))
    parts = [x.as_py().encode() for x in column]
    assert chat.parse(b"".join(parts)) == list(zip(roles, texts, strict=True))
    assert [chat.unescape_text(p[x:y].decode()) for p, x, y in zip(parts, a, b, strict=True)] == texts
    with pytest.raises(ValueError, match="no turn"):
        chat.parse(b"x" + parts[0])


def test_op7(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "x<|im_end|>"), (1, 2, "assistant", None), (2, 5, None, "b"), (2, 5, None, "a"), (None, 0, "user", "q"), (3, 0, "assistant", "z" * 100000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    want = {}
    for c in (1, 2, 3, None):
        own = sorted((t, r or "", x or "") for i, t, r, x in turns if i == c)
        learnt = "".join(x for _, r, x in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    rendered = chat.render(df)
    assert {r[0]: tuple(r)[1:5] for r in chat.digests(rendered).collect()} == want
    joined = {r.conv_id: r.formatted for r in chat.joined(rendered).collect()}
    assert chat.parse(joined[1].encode()) == [("user", "hi"), ("assistant", ""), ("assistant", "x<|im_end|>")] or chat.parse(joined[1].encode()) == [("user", "hi"), ("assistant", "x<|im_end|>"), ("assistant", "")]
    assert chat.digests(chat.render(df.limit(0))).count() == 0


def test_op7_on_a_whole_table(spark, sf):
    """Against the plain turns, the planted conversation included."""
    hard = "</s>[INST] ok [/INST]"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + [(-1, 0, "user", hard), (-1, 1, "assistant", hard)]
    held = collections.defaultdict(list)
    for c, t, r, x in turns:
        held[c].append((t, r or "", x or ""))
    found = {r.conv_id: r for r in chat.op7(spark, sf).collect()}
    assert set(found) == set(held)
    for c, own in held.items():
        own.sort()
        learnt = "".join(x for _, r, x in own if r == "assistant")
        column, _, _ = chat.assemble(pa.array([r for _, r, _ in own]), pa.array([x for _, _, x in own]))
        assert found[c].n_turns == len(own)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert found[c].formatted_chars == sum(len(x.as_py()) for x in column)


def test_op8(spark, docs, no_docs):
    r = random.Random(5)
    items = [(i, " ".join(f"item{r.randrange(300)}" for _ in range(15 + 3 * i))) for i in range(15)] + [(50, "tiny item"), (51, None), (52, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    noise = " ".join(f"noise{r.randrange(300)}" for _ in range(100))
    held = [(1000 + i, f"{noise[:-5]} {t.upper()}!! {noise}") for i, t in items[:16]]
    near = []
    for i, t in items[10:15]:
        w = t.split()
        w[len(w) // 2] = "edited"
        near.append((2000 + i, " ".join(w)))
    found = {(x.doc_id, x.item_id) for x in simhash.leaks(spark.createDataFrame(held + near + [(3000, noise), (None, items[3][1]), (3001, None)], "doc_id long, text string"), bench, most=7).collect()}
    assert found == {(1000 + i, i) for i, _ in items[:15]} | {(1050, 50)} | {(2000 + i, i) for i, _ in items[10:15]} | {(None, 3)}
    assert simhash.leaks(docs, bench).count() == 0
    assert simhash.leaks(no_docs, bench).count() == 0
    assert simhash.leaks(docs, bench.limit(0)).count() == 0


def test_simhash_finds_all_within_the_radius():
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(20)]
    prepared = simhash.Items(items, {}, len(items))
    column = pa.array([" ".join(r.choice(vocabulary) for _ in range(3000))], pa.large_string())
    hashes, bounds = simhash.split(column)
    running = simhash.sums(hashes)
    stride, length, item, offset, prints, _ = prepared.classes[0]
    starts = np.arange(0, len(hashes) - length + 1, stride)
    own = simhash.fingerprints(running, starts, length)
    want = {(int(item[j]), int(s - offset[j])) for k, s in enumerate(starts) for j in np.flatnonzero(np.bitwise_count(own[k] ^ prints) <= simhash.RADIUS)}
    assert {tuple(p) for x in prepared.near(running, bounds) for p in np.stack(x, 1).tolist()} == want


def brute_share(item, document):
    """The largest share of the item's runs that a stretch of the document of one and a half times its length has."""
    n = len(item)
    runs = collections.Counter(tuple(item[i : i + 5]) for i in range(n - 4))
    best = 0
    for at in range(-n // 2, len(document) - n // 2):
        part = document[max(0, at) : max(0, at + n + n // 2)]
        found = collections.Counter(tuple(part[i : i + 5]) for i in range(len(part) - 4))
        best = max(best, sum((runs & found).values()) / sum(runs.values()))
    return best


def test_op8_rules_out_only_what_cannot_reach_the_similarity():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]  # so few words that windows are near by chance
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([3, 4, 5, 12, 15, 18, 30, 33, 40, 41, 59, 120])] + [(12, "a a a a a b a a a a a b a a")]
    texts = ["", None, "a " * 50, "w1"] + [" ".join(rng.choice(vocabulary, 400)) for _ in range(30)]
    for _, item in items:
        own = item.split()
        for rate in (0.0, 0.03, 0.06, 0.1):
            texts.append(" ".join(["x", *(f"y{j}" if rng.random() < rate else w for j, w in enumerate(own)), "z"]))
        texts += [" ".join(own[1:]), " ".join(own[: len(own) // 2] + own)]
    prepared = simhash.Items(items, {}, len(items))
    column = pa.array(texts, pa.large_string())
    hashes, bounds = simhash.split(column)
    near = sorted({(int(i), int(a)) for items_, at in prepared.near(simhash.sums(hashes), bounds) for i, a in zip(items_, at, strict=True)})
    flat, best = [w for t in texts for w in (t or "").split()], {}
    for i, at in near:
        own = items[i][1].split()
        k, slack = min(5, len(own)), len(own) // 4
        middle = min(max(at + len(own) // 2, 0), len(flat) - 1)
        text = max(t for t in range(len(texts)) if bounds[t] <= middle < bounds[t + 1])
        there = flat[max(at - slack, bounds[text]) : min(at + len(own) + slack, bounds[text + 1])]
        held, want = (collections.Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1)) for x in (there, own))
        share = (held & want).total() / want.total()  # all runs are equally rare here
        if share >= simhash.SIMILARITY and share > best.get((text, i), (0, 0))[0]:
            best[text, i] = share, at
    found = {(t, i): (s, a) for t, i, a, s in prepared.search(column)}
    assert found.keys() == best.keys() and len(found) > 40
    assert all(found[x] == (pytest.approx(s), max(0, a - bounds[x[0]])) for x, (s, a) in best.items())
    left = prepared.possible(hashes, bounds, prepared.shingled(hashes, bounds))
    assert {(i, a) for i, a, *_ in left.tolist()} <= set(near)
    chance = [x for x in near if bounds[4] <= x[1] < bounds[33]]  # texts without an item: each of these was compared run by run before
    assert len(chance) > 100 and np.count_nonzero((left[:, 2] >= 4) & (left[:, 2] < 34)) * 20 < len(chance)


@pytest.mark.parametrize("kind", ["whole", "scattered", "head", "tail", "middle", "grown"])
def test_op8_recall_against_brute_force(kind):
    """Copies of items of many lengths, changed in different ways, that keep 0.8 or more of the item's runs."""
    r = random.Random(kind)
    word = lambda: f"w{min(r.randrange(4000), r.randrange(4000), r.randrange(4000))}"
    items = [[word() for _ in range(n)] for n in [12, 16, 20, 25, 30, 40, 55, 60, 80, 110, 150, 250, 400, 700, 1000] for _ in range(6)]
    texts, wanted = [], []
    for k, item in enumerate(items):
        n, w = len(item), list(item)
        lost = max(1, (n - 4) // 6)  # runs to lose, about
        if kind == "scattered":
            for _ in range(max(1, lost // 5)):
                w[r.randrange(n)] = word()
        elif kind == "head":
            w = w[lost:]
        elif kind == "tail":
            w = w[: n - lost]
        elif kind == "middle":
            a = r.randrange(1, n - lost)
            w[a : a + max(1, lost - 4)] = [word() for _ in range(max(1, lost - 4))]
        elif kind == "grown":
            for _ in range(max(1, lost // 5)):
                w.insert(r.randrange(n), word())
        document = [word() for _ in range(r.randrange(30))] + w + [word() for _ in range(30)]
        if brute_share(item, document) >= 0.8:
            wanted.append((len(texts), k))
        texts.append(" ".join(document))
    prepared = simhash.Items([(k, " ".join(x)) for k, x in enumerate(items)], {}, len(items))
    found = {(t, i) for t, i, _, _ in prepared.search(pa.array(texts, pa.large_string()))}
    recall = len(found & set(wanted)) / len(wanted)
    print(kind, len(wanted), recall)
    assert len(wanted) >= 40
    assert recall >= (1 if kind == "whole" else 0.95)
    assert {t for t, _ in found} <= {t for t, k in found if t == k}  # no other item's


def test_op8_weights_are_those_of_all_items(spark):
    """However the items are dealt to passes, the same rows come out."""
    r = random.Random(8)
    word = lambda: f"w{min(r.randrange(300), r.randrange(300))}"
    common = [word() for _ in range(12)]
    items = [(i, " ".join(common + [word() for _ in range(r.randrange(8, 40))])) for i in range(25)]
    docs = []
    for i, t in items:
        w = t.split()
        for _ in range(1 + i % 4):
            w[r.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = [{(x.doc_id, x.item_id, round(x.similarity, 9)) for x in simhash.leaks(df, bench, most).collect()} for most in (10**6, 100)]
    assert rows[0] == rows[1]
    assert len(rows[0]) > 5


def test_op8_clean_keeps_rows_by_their_own_text(spark):
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(None, item, "a"), (1, item, "b"), (1, "nothing here to see for anyone", "c"), (2, None, "d"), (2, "", "e"), (None, "some words", "f"), (3, item + " more", "g"), (3, item + " more", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __note string")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    assert sorted(x[2] for x in simhash.clean(docs, bench).collect()) == ["c", "d", "e", "f"]
    assert {x.doc_id for x in simhash.clean(docs, bench).where("text IS NULL").collect()} == {2}
    assert simhash.clean(docs, bench.limit(0)).count() == len(rows)


def test_op6_one_id_of_many_rows(spark):
    rows = [(None, f"text {i:03d}") for i in range(60)] + [(5, f"other {i:03d}") for i in range(60)] + [(7, "end")]
    found = sorted((tuple(r) for r in pfor.read(pfor.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()), key=lambda r: r[1])
    whole, _, _ = pfor.tokenizer(None)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r)):
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert found == want


def test_op9_compacts_on_its_main_path(spark, docs, monkeypatch):
    done, compact = [], substrings.compact
    monkeypatch.setattr(substrings, "compact", lambda runs, n: done.append(len(runs)) or compact(runs, n))
    substrings.deduplicate(docs).count()
    assert done == [3]


def test_op9(spark, docs, rows, no_docs):
    held = [(i, WORD.findall(t or "")) for i, t in rows]
    first: dict = {}
    for i, w in held:
        if i is not None:
            for j in range(len(w) - 12):
                key = tuple(w[j : j + 13])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in held:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    want.sort(key=lambda r: tuple((x is not None, str(x)) for x in r))
    for batches in (1, 4):
        assert got(substrings.deduplicate(docs, batches)) == want
    assert substrings.deduplicate(no_docs).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t):
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(re.sub("[ -]", "", m)) <= 19 and pii.luhn(re.sub("[ -]", "", m)),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, t) if ok[k](m[0])] for k, p in BASE.items()}


def test_pii_spans():
    r = random.Random(3)
    for alphabet in ("a1.@-+ %", "0123456789. -+()", "12. -+@a", "4 -1"):
        for _ in range(1500):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            assert {"email": pii.emails(t), "ip": pii.ips(t), "card": pii.cards(t), "phone": pii.phones(t)} == brute_spans(t)
    assert pii.ibans("pay to GB82 WEST 1234 5698 7654 32 now") == [(7, 34)]
    assert pii.ibans("pay to GB82 WEST 1234 5698 7654 33 now") == []
    assert [s.kind for s in pii.find("ssn 123-45-6789")] == ["ssn"]
    assert pii.find("part 123-45-6789") == []
    assert pii.redact("a@b.cd or 4111 1111 1111 1111.") == "[EMAIL] or [CARD]."


@pytest.mark.parametrize("code", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"])
@pytest.mark.parametrize("after", ["", " BIC COBADEFFXXX", " Please confirm", " A note", " 4715", " 2024 10 05", ". Thanks", " NO93 8601 1117 947", " PLEASE PAY BY FRIDAY MORNING AT TEN"])
def test_ibans_before_other_words(code, after):
    text = f"IBAN {code}{after}"
    want = [(5, 5 + len(code))] + ([(6 + len(code), len(text))] if "NO93" in after else [])
    assert pii.ibans(text) == want
    assert code not in pii.redact(text) and pii.redact(text).startswith("IBAN [IBAN]")
    assert pii.ibans(f"IBAN {code}1") == [] and pii.ibans(f"IBAN {code[:-1]}{(int(code[-1]) + 1) % 10}{after}")[:1] in ([], want[1:])


@pytest.mark.parametrize(
    ("text", "kind"),
    [("Numéro de sécurité sociale 123-45-6789", "ssn"), ("Sozialversicherung: 123-45-6789", "ssn"), ("seguridad social 123-45-6789", "ssn"), ("modèle 123-45-6789, sécurité", None), ("Bestellung 123-45-6789", None)],
)
def test_pii_context_in_four_languages(text, kind):
    assert [s.kind for s in pii.find(text)] == ([kind] if kind else [])


def test_pii_added_spans_do_not_overlap():
    text = "social 123-45-6789 IBAN DE89 3704 0044 0532 0130 00 card 4111 1111 1111 1111 social security 987-65-4320 and +49 30 1234567"
    spans = sorted((s.start, s.end) for s in pii.find(text) if s.kind in ("iban", "ssn"))
    assert len(spans) == 2
    taken = pii._Taken([(5, 9), (7, 12), (20, 22)])
    assert [taken.free(a, b) for a, b in ((0, 5), (0, 6), (12, 20), (11, 13), (22, 30), (21, 30), (1, 40))] == [True, False, True, False, True, False, False]
    taken.add(12, 20)
    assert not taken.free(15, 16)


def test_op10_equals_the_plain_expressions_on_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r for r in pii.op10(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    seen = 0
    for i, t in rows:
        want = brute_spans(t or "")
        assert [found[i][f"n_{k}"] for k in pii.BASE_KINDS] == [len(want[k]) for k in pii.BASE_KINDS]
        base = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in want[k])
        assert found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        seen += len(base) > 0
    assert seen > 5


def test_pii_takes_linear_time_on_long_runs():
    import time

    start = time.process_time()
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" + "(" * 300_000, "1 " * 150_000):
        pii.find(t)
    assert time.process_time() - start < 20


def test_op10(spark, docs, rows, no_docs):
    assert pii.detect(docs).count() == len(rows)
    df = spark.createDataFrame([(1, "mail é@x a@b.co, 10.0.0.1"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.detect(df).collect()}
    assert found[1].spans == "email:9:15,ip:17:25"
    assert found[1].base_sha256 == hashlib.sha256(b"email:9:15,ip:17:25").hexdigest()
    assert found[2].spans == ""
    assert pii.detect(no_docs).count() == 0


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(9)
    sentence = lambda: " ".join(f"word{r.randrange(400)}" for _ in range(30)).capitalize() + "."
    good = [(i, "\n".join(sentence() for _ in range(3))) for i in range(60)]
    bad = [(100 + i, "!!! $$$ ### " * (5 + i)) for i in range(60)]
    item = sentence()
    special = [(200, good[5][1]), (201, sentence() + "\n" + item + "\n" + sentence()), (202, sentence() + "\n" + sentence() + "\nWrite to a@b.co about " + sentence())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in good + bad + special], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    encoder = bpe.encoder(None)
    want = {i: t for i, t in good} | {202: special[2][1].replace("a@b.co", "[EMAIL]")}
    assert set(found) == set(want)
    for i, t in want.items():
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, encoder.encode_ordinary(t))).encode()).hexdigest()


def test_pipeline_takes_rows_of_every_kind(spark, tmp_path):
    """Null, empty, long and repeated texts, null and repeated ids, columns with names that stages use, empty tables."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(10)
    sentence = lambda: " ".join(f"word{r.randrange(900)}" for _ in range(30)).capitalize() + "."
    good = [(i, "\n".join(sentence() for _ in range(3))) for i in range(60)]
    bad = [(100 + i, "!!! $$$ ### " * (5 + i)) for i in range(60)]
    item = sentence()
    a, b, c = (sentence() + "\n" + sentence() for _ in range(3))
    long = "\n".join(sentence() for _ in range(3000))
    special = [(None, a), (None, sentence() + "\n" + item), (300, b), (300, c), (301, b + " more"), (302, c + " more"), (303, item + "\n" + a[:40]), (304, long), (304, long), (305, None), (306, ""), (307, None)]
    rows = [(i, t, "en", None, None if t is None else len(t), 1.5, "x", 7) for i, t in good + bad + special]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, version string, __text int"
    folder = str(tmp_path / "a")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark = spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    found = collections.Counter((x.doc_id, x.n_tokens) for x in corpus_pipeline.run(spark, folder).collect())
    encoder = bpe.encoder(None)
    want = collections.Counter((i, len(encoder.encode_ordinary(t))) for i, t in [*good, (None, a), (300, b), (300, c), (304, long)])
    empty = {k: n for k, n in found.items() if k[1] == 0}  # those without text are one class, if the score keeps them
    assert sum(empty.values()) <= 1
    assert found - collections.Counter(empty) == want
    empty = str(tmp_path / "b")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    labels.limit(0).write.parquet(f"{empty}/labels.parquet")
    benchmark.limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_op5(spark):
    from millrace.llm import warc

    records = [
        (1, "https://a.example.com/x?utm_source=q", 10, "response", "e1", "d1", {"date": "1", "content-type": "t"}, "one"),
        (2, "https://a.example.com/x/", 20, "revisit", "e1", None, {"date": "2", "content-type": "u"}, None),
        (3, "https://a.example.com/x", 200_000, "response", "e2", "d2", {"date": "3"}, "two"),
        (4, "https://a.example.com/x", 200_000, "revisit", "e1", None, None, None),
        (5, "https://a.example.com/x", 900_000, "revisit", None, "d2", {"etag": "e2"}, None),
        (6, "https://a.example.com/x", 5, "revisit", "e1", None, {}, None),
        (7, None, 5, "revisit", "e1", None, {}, None),
        (8, "https://a.example.com/x", 900_000, "revisit", None, None, None, None),
        (8, "https://a.example.com/x", 900_000, "revisit", None, None, None, None),
        (9, "https://b.example.com/", None, "revisit", "e1", None, {}, None),
        (10, "https://a.example.com/x", 200_000, "revisit", "e2", "d1", {}, None),
        (3, "https://a.example.com/x", 200_000, "response", "e2", "d2", {"date": "3"}, "two"),
        (11, "https://c.example.com/x", None, "response", "e1", None, {}, "untimed"),
        (200_000, "https://c.example.com/x", None, "revisit", "e1", None, {}, None),
        (12, "https://c.example.com/x", 5, "revisit", "e1", None, {}, None),
        (13, "https://c.example.com/x", 5, None, "e1", None, {}, "x"),
        (14, None, 5, "request", None, None, None, None),
    ]
    df = spark.createDataFrame(records, "record_id long, uri string, at long, kind string, etag string, last_modified string, headers map<string,string>, payload string").withColumn("chunk", F.lit("clash"))
    for chunk in (warc.CHUNK, 7, 10**9):
        found = warc.resolve(df, chunk).collect()
        by = {r.record_id: r for r in found}
        assert len(found) == len(records)
        assert {i: (r.status, r.source_id, r.payload) for i, r in by.items()} == {
            1: ("full", None, "one"), 2: ("resolved", 1, "one"), 3: ("full", None, "two"), 4: ("validator_mismatch", None, None), 5: ("resolved", 3, "two"), 6: ("no_earlier", None, None),
            7: ("no_address", None, None), 8: ("no_validator", None, None), 9: ("no_earlier", None, None), 10: ("resolved", 3, "two"),
            11: ("full", None, "untimed"), 200_000: ("resolved", 11, "untimed"), 12: ("resolved", 11, "untimed"), 13: ("unknown_kind", None, None), 14: ("unknown_kind", None, None),
        }
        assert by[2].headers == {"date": "2", "content-type": "t"}
        assert by[5].headers == {"date": "3", "etag": "e2"}
    assert warc.resolve(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(0, "https://a.example.com/p", "h"), (1, None, None), (1, None, None)], "page_id long, url string, html string")
    assert warc.resolve(warc.captures(pages)).count() == 9
    twice = warc.resolve(warc.captures(spark.createDataFrame([(4, "https://a.example.com/p", "h")] * 2, pages.schema)))
    assert twice.count() == 6
    assert twice.where("status = 'resolved'").count() == 2
