"""Operators 11 to 13 against plain versions of themselves."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from millrace.llm import alignment, nearest, repair


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def plain_alignment(rows):
    """Whole texts through both libraries, positions by position."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    level = alignment._byte_level()
    out, links_of, links = [], [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a_ids, b_ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        a_bytes = [bytes(level[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in b_ids]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append((doc_id, 0, 0, 0, 0, ""))
            links_of.append([])
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, own, i, j = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            x, y = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append(",".join(map(str, a_ids[i:x])) + "|" + ",".join(map(str, b_ids[j:y])))
            own.append((a_ids[x - 1], b_ids[y - 1]))
            i, j = x, y
        links.update(own)
        links_of.append(own)
        out.append((doc_id, len(a_ids), len(b_ids), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b_id), n in links.items():
        most[b_id] = max(most[b_id], n)
    return [(*row[:5], sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own), row[5]) for row, own in zip(out, links_of, strict=True)]


def test_alignment_equals_the_libraries(spark, sf, rows):
    r = random.Random(5)
    units = [*"ab the  \n\n\t.,!?'sSé中ß0129<|>\u2581\x00\x1c\x85\xa0\u2003\u3000\r_-", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", " the", "ing", " n't", "\U0001f600", "\u200b", "\ufeff"]
    made = [(i, "".join(r.choice(units) for _ in range(r.randint(0, 40)))) for i in range(1500)]
    plain = [u for u in units if u != "\u2581"]
    made += [(i, "".join(r.choice(plain) for _ in range(r.randint(0, 300)))) for i in range(1500, 1800)]
    made += [(i, t) for i, t in rows if not t or len(t) < 30000]  # the plain version is slow on long texts
    table = pq.read_table(f"{sf}/documents.parquet").slice(0, 60)
    made += list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    docs = spark.createDataFrame([(i, t, "n") for i, t in made], "doc_id long, text string, number string").repartition(5)
    assert by_text(alignment.aligned(docs).collect()) == by_text(plain_alignment(made))
    assert alignment.aligned(docs.limit(0)).collect() == []


def test_alignment_of_long_texts_and_small_blocks(spark, monkeypatch):
    texts = ["a" * 50000, "word " * 20000, "中文" * 9000, "x y\n" * 3000]
    assert [len(x) for x in alignment.encode_pieces(["\n", " ", "\n\n a"], None, None)[1]] == [1, 1, 3]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(got[i] == got[i + 4] for i in range(4))
    monkeypatch.setattr(alignment, "KEPT_PIECES", 50)
    block = alignment.Block(None, None)
    import pyarrow as pa

    words = [" ".join(f"w{i * j % 97}" for j in range(40)) for i in range(60)]
    small = [x[:5] for i in range(60) for x in block.add(pa.array([i]), pa.array(words[i : i + 1], pa.large_string()))]
    assert small == [r[:4] + r[7:] for r in plain_alignment(list(enumerate(words)))]


def plain_repairs(rows):
    """Damage, faults and the cheapest edits by recursion over rows and states."""
    conversations = defaultdict(list)
    for conv_id, turn, role, text in rows:
        own = conversations[conv_id]
        role, text = " " if role is None else role, " " if text is None else text
        damage = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if damage:
            text = "" if damage == 1 else re.sub(r"[.!?]", "", text) if damage == 2 else text
            own += [(turn, "user" if damage == 4 else role, text)] * (2 if damage == 3 else 1)
    return [(conv_id, *plain_repair(own)) for conv_id, own in conversations.items()]


FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_repair(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    sys.setrecursionlimit(100_000)

    @functools.cache
    def cheapest(i, state, inserts):
        """(cost, audit, repaired turns) of rows i and after."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, rest = cheapest(i + 1, state, 3)
            found.append((cost + repair.DELETE_COST, "D" + audit, rest))
            if faults[i] in ("", "truncated"):
                for name, edit, price in ((role, "K", 0), ("user", "R", repair.REROLE_COST), ("assistant", "R", repair.REROLE_COST)):
                    if (state, name[:1]) in FOLLOWS:
                        cost, audit, rest = cheapest(i + 1, FOLLOWS[state, name[:1]], 3)
                        found.append((cost + price + (repair.TRUNCATED_COST if faults[i] else 0), edit + audit, (f"{name}:{text}", *rest)))
        for name in ("user", "assistant") if inserts else ():
            if (state, name[0]) in FOLLOWS:
                cost, audit, rest = cheapest(i, FOLLOWS[state, name[0]], inserts - 1)
                found.append((cost + repair.INSERT_COST, "I" + audit, (f"{name}:", *rest)))
        return min(found, key=lambda x: x[:2]) if found else (1 << 40, "", ())

    cost, audit, rest = cheapest(0, "", 3)
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(rest).encode()).hexdigest())


def odd_conversations(seed):
    r = random.Random(seed)
    texts = ["a.", "b", "c!", "", " ", None, "d?\n", "e. x", "f.\t ", "\n", "\u3000.", "é"]
    rows = []
    for c in range(300):
        rows += [(c, r.choice([None] + [i] * 12 + [i - 1, -3, 50]), r.choice(["user", "assistant"] * 6 + ["system", "tool", None, "", "s", "University"]), r.choice(texts + [f"{r.random()}."] * 12)) for i in range(r.randint(0, 14))]
    rows += [(None, i, r.choice(["user", "assistant"]), r.choice(texts)) for i in range(9)]
    return rows + [(1000, i, r.choice(["user", "assistant"]), r.choice(["k.", "l", f"{i}!"])) for i in range(300)]


def test_repair_equals_recursion(spark, sf):
    rows = odd_conversations(5) + [(10_000 + x["conv_id"], x["turn"], x["role"], x["text"]) for x in pq.read_table(f"{sf}/conversations.parquet").to_pylist()]
    table = spark.createDataFrame([(*x, "c", 1) for x in rows], "conv_id long, turn long, role string, text string, gone string, symbol int").repartition(5)
    assert by_text(repair.repaired(repair.damaged(table)).collect()) == by_text(plain_repairs(rows))
    assert repair.repaired(repair.damaged(table.limit(0))).collect() == []


def test_repair_with_cheap_inserts(monkeypatch):
    """At other costs inserts are made, also at the ends and several in a row."""
    monkeypatch.setattr(repair, "INSERT_COST", 1)
    monkeypatch.setattr(repair, "DELETE_COST", 6)
    monkeypatch.setattr(repair, "REROLE_COST", 4)
    r, audits = random.Random(3), Counter()
    machine = repair.Automaton()
    roles = {"system": repair.SYSTEM, "user": repair.USER, "assistant": repair.ASSISTANT, "tool": repair.NONE}
    for _ in range(400):
        names = [r.choice(list(roles)) for _ in range(r.randint(0, 9))]
        rows = [(i, n, f"{i}" + r.choice([".", ""])) for i, n in enumerate(names)]
        symbols = bytes(roles[n] * 4 + (repair.SOUND if t.endswith(".") else repair.TRUNCATED) for _, n, t in rows)
        want = plain_repair(rows)
        assert machine.solve(symbols) == (want[5], want[6])
        audits.update(want[6])
    assert audits["I"] > 100


def plain_nearest(ids, vectors, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (vectors * vectors[i]).sum(1)
        order = np.lexsort((ids, -scores))
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order if ids[j] != ids[i]][:k]
    return out


def recall(df, ids, vectors):
    got, want, hits = defaultdict(list), plain_nearest(ids, vectors), 0
    for r in df.collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    for q, true in want.items():
        own, scores = sorted(got[q]), dict(true)
        assert [x[0] for x in own] == list(range(1, len(true) + 1))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(own, own[1:], strict=False))
        assert all(abs(scores[i] - s) < 1e-12 for _, i, s in own if i in scores)
        hits += sum(i in scores for _, i, _ in own)
    return hits / sum(map(len, want.values()))


def test_nearest_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    table = pq.read_table(f"{folder}/embeddings.parquet")
    assert recall(nearest.op11(spark, folder), np.array(table["vec_id"].to_pylist()), np.array(table["embedding"].to_pylist(), np.float64)) >= 0.95


def test_nearest_with_copies_and_norms(spark):
    """A hot group of copies, one of near copies, norms that vary, and rows that take no part."""
    r = np.random.default_rng(1)
    vectors = r.normal(size=(3000, 24)) * r.uniform(0.2, 3, size=(3000, 1))
    vectors[500:1500] = vectors[7]
    vectors[1500:1700] = vectors[8] + r.normal(size=(200, 24)) * 0.01
    ids = np.arange(3000)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    none = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (5080, [1.0]), (5100, []), (5120, [float("inf")] * 24), (None, [1.0] * 24)]
    table = spark.createDataFrame([(*x, "v", 3) for x in rows + rows[40:60] + none], "vec_id long, embedding array<double>, v string, cell int").repartition(6)
    assert recall(nearest.nearest(table), ids, vectors) >= 0.95
    assert nearest.nearest(table.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 15, 30])
def test_nearest_of_few_is_exact(spark, n):
    r = np.random.default_rng(n)
    vectors = r.normal(size=(n, 3)).round(1) + 0.05
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.collect() == [] if n == 1 else recall(got, np.arange(n), vectors) >= 0.9


def test_every_code_within_the_radius_is_found():
    r = np.random.default_rng(2)
    codes = r.integers(0, 256, (500, nearest.PARTS), dtype=np.uint8)
    codes[:200] = codes[0] ^ np.packbits(r.random((200, nearest.BITS)) < r.uniform(0, 0.3, (200, 1)), axis=1)
    bits = np.bitwise_count(codes ^ codes[0]).sum(1)
    for radius in (0, 1, 31, 32, 40, 63, 100, 128, 256):
        assert nearest.Index(codes, radius).within(codes[0]).tolist() == np.flatnonzero(bits <= radius).tolist()


def test_bagminhash_second_pass_is_exact_and_spanning(spark, monkeypatch):
    """With hashes so short that nearly all links of the first pass are wrong, the second pass finds the classes."""
    from millrace.llm import bagminhash

    r, own = random.Random(9), []
    for i in range(120):
        w = [f"w{j}" for j in range(200)]
        for _ in range(r.randint(2, 6)):
            w[r.randrange(200)] = f"x{r.randrange(10**9)}"
        own.append((i, " ".join(w)))
    docs = spark.createDataFrame(own, "doc_id long, text string")
    want = {x.doc_id: x.class_id for x in bagminhash.classes(docs).collect()}
    passes, links = [], bagminhash._links_between
    monkeypatch.setattr(bagminhash, "SHORT_BITS", 7)
    monkeypatch.setattr(bagminhash, "NEAREST", 1)
    monkeypatch.setattr(bagminhash, "_links_between", lambda known, sketches, wide: passes.append((wide, (found := links(known, sketches, wide)).count(), known.select("key").distinct().count())) or found)
    assert {x.doc_id: x.class_id for x in bagminhash.classes(docs).collect()} == want
    assert [wide for wide, _, _ in passes] == [False, True]
    assert passes[1][1] < 120 * passes[1][2]  # for each band fewer links than nodes


def plain_measures(text):
    """The measurements of each line of a text, one line and one word at a time."""
    import math

    count = lambda raw, test: sum(test(chr(b)) for b in raw)
    white = re.compile(rb"[^\x20\x09-\x0D]+")
    rows, seen_lines, seen_runs, words = [], set(), set(), []
    lines = text.encode().split(b"\n")
    for i, raw in enumerate(lines):
        words += [(w, i) for w in white.findall(raw)]
    runs = Counter()
    again = Counter()
    for j in range(len(words) - 4):
        run = tuple(w for w, _ in words[j : j + 5])
        runs[words[j][1]] += 1
        again[words[j][1]] += run in seen_runs
        seen_runs.add(run)
    same_words = Counter(words[j][1] for j in range(1, len(words)) if words[j][0] == words[j - 1][0])
    for i, raw in enumerate(lines):
        own = white.findall(raw)
        letters = lambda c: c.isalpha() and c.isascii() or ord(c) >= 0xC0
        size = max(1, count(raw, lambda c: not 0x80 <= ord(c) < 0xC0))
        n, per_word, n_letters = len(own), max(1, len(own)), count(raw, lambda c: letters(c) or c.isalpha())
        same = sum(raw[k] == raw[k - 1] and not (letters(chr(raw[k])) or chr(raw[k]).isalpha()) for k in range(1, len(raw)))
        rows.append([
            math.log1p(size), math.log1p(n), n_letters / size, count(raw, lambda c: c.isascii() and c.isupper()) / max(1, n_letters), count(raw, lambda c: c.isascii() and c.isdigit()) / size, count(raw, lambda c: c in ".?,;:") / per_word, count(raw, lambda c: c == "!") / per_word,
            count(raw, lambda c: c in "#$%&*|<>{}[]\\^~=+_@/") / per_word, (size - count(raw, lambda c: c in " \t\r\v\f")) / per_word, sum(len(w) <= 3 for w in own) / per_word, same / size, same_words[i] / per_word, again[i] / max(1, runs[i]), float(raw in seen_lines and n > 0), float(raw[-1:] in (b".", b"?", b"!") and raw != b""),
        ])
        seen_lines.add(raw)
    return rows, [len(raw) for raw in lines]


def plain_score(text, model):
    """A text's score by sums over all labellings, carried forward and backward line by line."""
    import bisect
    import math

    rows, sizes = plain_measures(text)
    bins = [[bisect.bisect_right(e.tolist(), float(np.float32(v))) for e, v in zip(model.edges, row, strict=True)] for row in rows]
    none = [len(model.edges[0]) + 1] * len(model.edges)
    at = lambda i: bins[i] if 0 <= i < len(bins) else none
    speaks = [sum(model.weights[k][m][b] for k, d in ((0, 0), (1, -1), (2, 1)) for m, b in enumerate(at(i + d))) for i in range(len(bins))]
    up = [(1.0, math.exp(min(30, max(-30, e)))) for e in speaks]
    t = np.exp(model.links)
    forward, back = [list(up[0])], [[1.0, 1.0]]
    for i in range(1, len(up)):
        f = [sum(forward[-1][a] * t[a][b] for a in (0, 1)) * up[i][b] for b in (0, 1)]
        forward.append([x / sum(f) for x in f])
    for i in range(len(up) - 1, 0, -1):
        b = [sum(t[x][y] * up[i][y] * back[0][y] for y in (0, 1)) for x in (0, 1)]
        back.insert(0, [x / sum(b) for x in b])
    p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, back, strict=True)]
    mean = sum(x * (s + 1) for x, s in zip(p, sizes, strict=True)) / sum(s + 1 for s in sizes)
    mean = min(1 - 1e-4, max(1e-4, mean))
    a, c = model.curve
    return 1 / (1 + math.exp(-(a * math.log(mean / (1 - mean)) + c)))


def test_line_crf_scores_equal_a_plain_version(spark, sf, rows):
    """All scores of the query, and of odd rows, computed again line by line."""
    from pyspark.sql import functions as F

    from millrace.llm import crf

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = crf.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert isinstance(model, crf.Model)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.score for r in crf.op4(spark, sf).collect()}
    assert set(got) == set(texts)
    assert max(abs(got[i] - plain_score(t, model)) for i, t in texts.items()) < 1e-6
    odd = [(i, t) for i, (_, t) in enumerate(rows)] + [(100, "."), (101, ".. a"), (102, "!"), (103, "!!\n!!"), (104, "x.")]
    found = crf.score(spark.createDataFrame(odd, "doc_id long, text string").coalesce(1).orderBy(F.desc("doc_id")), model).collect()
    want = dict(odd)
    assert max(abs(r.score - plain_score(want[r.doc_id] or "", model)) for r in found) < 1e-6
    import pyarrow as pa

    measures = crf.measure(pa.record_batch({"text": pa.array(["!!", "!", "", "!"], pa.large_string())}))[0]
    assert measures[:, crf.MEASURES.index("same_bytes")].tolist() == [0.5, 0.0, 0.0, 0.0]  # whatever text comes before


def test_revisits_without_time_by_text_ids(spark):
    """Records without time are dealt to chunks by their text ids, and resolve as those with numbers do."""
    from millrace.llm import warc

    r = random.Random(4)
    rows = [(i, f"https://a.example.com/{r.randrange(3)}", r.choice([None, None, None, 50]), r.choice(["response", "revisit", "revisit"]), r.choice(["e1", "e2"]), None, {}, f"p{i}") for i in range(3000)]
    schema = "uri string, at long, kind string, etag string, last_modified string, headers map<string,string>, payload string"
    numbers = spark.createDataFrame(rows, "record_id long, " + schema)
    name = lambda i: None if i is None else f"urn:uuid:{i:08x}"
    texts = spark.createDataFrame([(name(x[0]), *x[1:]) for x in rows], "record_id string, " + schema)
    want = sorted((name(x.record_id), x.status, name(x.source_id) or "") for x in warc.resolve(numbers).collect())
    assert sorted((x.record_id, x.status, x.source_id or "") for x in warc.resolve(texts).collect()) == want
    part = warc._record_chunk(texts)[0]
    assert texts.where("at IS NULL").select(part.alias("c")).distinct().count() > 1
