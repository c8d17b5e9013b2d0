"""Each operator against a brute-force version, on texts with the usual edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from timberline.llm import bpe, chat, hilbert, licences, media, minhash, packing, quality, substring, tokens, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, band string, label bigint, words string"


def texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "Äther", "日本", "x.", "!"]
    long = [rng.choice(vocabulary) for _ in range(300)]
    out: list[str | None] = [None, "", "   \n\t", "one", "One", "two words", "Two  WORDS", "a b c d e f", " ".join(long), "\n".join(long[50:250])]
    for k in range(12):  # near copies
        copy = list(long)
        for _ in range(k * 2):
            copy[rng.randrange(300)] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    for _ in range(15):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        at = rng.randrange(len(own))
        out.append(" ".join(own[:at] + long[100 : 100 + rng.randrange(20, 60)] + own[at:]))
    out += [out[-1], out[-1], "na " * 90, "x" * 5000, "tail\x0btab\x0cfeed\r\n end"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "clash", i, "clash") for i, t in enumerate(texts())]
    rows.append(rows[8])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_media(docs, empty):
    rows = media.stored(docs).collect()
    assert len(rows) == docs.count()
    held = dict(enumerate(texts()))
    for r in rows:
        raw = (held[r.doc_id] or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), sha(full), zlib.crc32(full[-16:]))
        assert (r.width, r.height, r.bits) == (192, len(full) // 192, 8)
        assert r.digest.hex() == r.payload_sha256
        stored = media.to_png(full)
        assert (r.media_bytes, r.media_sha256) == (len(stored), sha(stored))
        values = list(full)
        mean = sum(values) / len(values)
        sd = (sum(v * v for v in values) / len(values) - mean * mean) ** 0.5
        common = max(sorted(set(values)), key=values.count) if len(values) < 10_000 else None
        if common is not None:
            assert r.feature == f"h={len(full) // 192};mean={mean:.4f};sd={sd:.4f};mode={common}"
    assert media.stored(empty).count() == 0
    assert media.from_png(media.to_png(bytes(range(192)) * 3)) == bytes(range(192)) * 3


def test_chat_rows(spark):
    hard = ["</s>[INST] ok [/INST]", "\\<|im_end|>\n", "a\\", "", None, "<\\s>", "<|im_start|>user\n$1", "\\\\n[/INST"]
    rows = [(c, t, role, hard[(c + t) % len(hard)], "x") for c in range(6) for t, role in enumerate(["system", "user\n<s>", "assistant", None])]
    rows += [(9, 0, "user", "same", "x"), (9, 0, "user", "same", "x"), (None, None, "assistant", "lost", "x")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string")
    turns = chat.turns_by_row(table)
    for r in chat.formatted(turns).collect():
        assert chat.parsed(r.piece) == [(r.role or "", r.text or "")]
        body = r.piece[len("<|im_start|>") : -len("<|im_end|>\n")]
        assert not any(c in body for c in chat.CONTROLS)
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(turns)).collect()}
    assert set(got) == set(by)
    for c, items in by.items():
        items.sort()
        loss = "".join(x for _, role, x in items if role == "assistant")
        assert got[c].n_turns == len(items)
        assert got[c].turns_sha256 == sha("".join(f"{a}\n{b}\n" for _, a, b in items).encode())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss.encode()))
    assert chat.digests(chat.formatted(turns.limit(0))).count() == 0


def test_chat_layouts(spark):
    records = [
        '{"prompt": "p", "completion": "c"}',
        '{"completion": "c", "prompt": null}',
        '{"instruction": "do", "input": "it", "output": "done"}',
        '{"instruction": "do", "input": "", "output": "done"}',
        '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}',
        '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": null}]}',
        '{"other": 1}',
        "broken",
        None,
    ]
    table = spark.createDataFrame(list(enumerate(records)), "conv_id bigint, record string")
    got = defaultdict(list)
    for r in chat.canonical(table).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.turn, r.role, r.text))
    assert got[0] == [(0, "user", "p"), (1, "assistant", "c")]
    assert got[1] == [(0, "user", ""), (1, "assistant", "c")]
    assert got[2] == [(0, "user", "do\n\nit"), (1, "assistant", "done")]
    assert got[3] == [(0, "user", "do"), (1, "assistant", "done")]
    assert got[4] == [(0, "user", "hi"), (1, "assistant", "yo")]
    assert got[5] == [(0, "user", "a"), (1, "assistant", "")]
    assert got[6] == got[7] == got[8] == [(-1, None, None)]


def repeated(held: dict, window: int) -> dict:
    counts = Counter(tuple(w[i : i + window]) for w in held.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in held.items():
        gone = {p for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("window", [35, 6])
def test_substring(docs, empty, window):
    held = {i: words(t) for i, t in enumerate(texts())}
    again = {**held, "again": held[8]}  # the repeated row counts
    want = repeated(again, window)
    rows = substring.mark(docs, window=window, text=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, gone, left = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, gone)
        assert r.kept_sha256 == sha(left.encode())
        assert words(r.kept) == left.split() if gone else r.kept == (texts()[r.doc_id] or "")
    assert substring.mark(empty).count() == 0


def test_substring_same_id(spark):
    line = " ".join(f"v{i}" for i in range(50))
    table = spark.createDataFrame([(1, line), (1, "other words"), (2, line + " more"), (None, "lone")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.mark(table).collect())
    assert got == [(-1, 1, 0), (1, 2, 0), (1, 50, 50), (2, 51, 50)]


def test_hilbert(spark, docs, empty):
    rows = hilbert.shards(docs, count=4).collect()
    assert len(rows) == docs.count()
    size = Counter(r.shard for r in rows)
    assert max(size.values()) - min(size.values()) <= 1
    for s, n in size.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    held = dict(enumerate(texts()))
    for r in rows:
        raw = (held[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert hilbert.shards(empty).count() == 0
    # neighbours on the curve are neighbours in space, and every cell has its own number
    cells = spark.sql("select a.id as x, b.id as y, c.id as z from range(8) a, range(8) b, range(8) c")
    walk = [(r.x, r.y, r.z) for r in cells.withColumn("h", hilbert.curve_index(["x", "y", "z"], 3)).orderBy("h").collect()]
    numbers = sorted(r.h for r in cells.withColumn("h", hilbert.curve_index(["x", "y", "z"], 3)).collect())
    assert numbers == list(range(512))
    assert all(sum(abs(i - j) for i, j in zip(a, b, strict=True)) == 1 for a, b in zip(walk, walk[1:], strict=False))


def curve_place(x: list[int], bits: int) -> int:
    """The place on the curve, found by descending through the cubes: each level turns the next one's axes."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            flip ^= q - 1
        q >>= 1
    x = [v ^ flip for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_hilbert_places(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["", None, *(f"text {k} " * (k % 9 + 1) for k in range(60))]), rng.choice(["de", "en", "fr", None]), f"s{min(rng.randrange(40), rng.randrange(40))}") for i in range(300)]
    got = hilbert.shards(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4), count=7, bits=3).collect()
    groups = {}
    for _, text, lang, source in rows:
        key = text or ""
        old = groups.get(key, ("~", "~"))
        groups[key] = (min(old[0], lang or ""), min(old[1], source))
    dims = {k: (v[0], v[1], len(k.encode()) + 1) for k, v in groups.items()}

    def cells(values):
        at, out = 0, {}
        for value, n in sorted(Counter(values).items()):
            out[value] = at * 8 // len(values)
            at += n
        return out

    by = [cells([d[k] for d in dims.values()]) for k in range(3)]
    place = {zlib.crc32(k.encode()): curve_place([by[j][d[j]] for j in range(3)], 3) for k, d in dims.items()}
    assert all(r.curve == place[r.text_crc32] for r in got)
    order = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in order] == list(range(300))
    assert [(r.curve, r.text_hash) for r in order] == sorted((r.curve, r.text_hash) for r in got)
    assert all(r.shard == r["rank"] * 7 // 300 for r in got)
    shards_of = defaultdict(set)
    for r in got:
        shards_of[r.text_hash].add(r.shard)
    assert sum(len(s) > 1 for s in shards_of.values()) <= 6


def test_hilbert_files(spark, docs, empty, tmp_path):
    assert hilbert.write(docs, str(tmp_path / "out"), count=4, file_bytes=2000) == "shard"
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert back.select("shard").distinct().count() == 4
    files = list((tmp_path / "out").glob("shard=*/*.parquet"))
    assert len(files) > 8
    clash = docs.selectExpr("*", "doc_id as shard", "7 as slot", "'mine' as text_hash", "1 as at")
    assert hilbert.write(clash, str(tmp_path / "clash"), count=3) == "shard_1"
    again = spark.read.parquet(str(tmp_path / "clash"))
    assert set(again.columns) == {*clash.columns, "shard_1"}
    assert sorted((r.doc_id, r.text or "", r.shard, r.slot, r.text_hash) for r in again.collect()) == sorted((r.doc_id, r.text or "", r.shard, 7, "mine") for r in clash.collect())
    hilbert.write(empty, str(tmp_path / "empty"), count=3)


ODD = ["", " ", "  a  b", "a \n b\n\nc ", "It's we'll I'M 'S", "İstanbul ẞtraße ΑΣ ſ", "12½ ² 3a", "<|endoftext|> x<|startoftext|>y", "é e ́", "　日本語 x", "😀😀 a😀b", "a\x1cb\x85c", "x" * 300]


def test_merge_replay(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = tokens.rank_vocabulary(path, public_tokenizers.PATTERN)
    for text, ids in zip(ODD, vocabulary.encode(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    held = dict(enumerate(texts()))
    for r in bpe.digests(docs, path, public_tokenizers.PATTERN).collect():
        want = library.encode_ordinary(held[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(want), sha(" ".join(map(str, want)).encode()))
        assert r.decoded_sha256 == sha((held[r.doc_id] or "").encode())
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (held[r.doc_id] or "").encode() and r.band == "clash" for r in back.collect())
    assert bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0


def near(held: dict, percent: int = 80) -> dict:
    sets = {}
    for k, t in held.items():
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in words(t)]
        sets[k] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {k: (len(sets[k]), label[k], label[k] == k) for k in sets}


def test_minhash(docs, empty):
    want = near(dict(enumerate(texts())))
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id], r
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(200, 200)]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if v != k}


def test_minhash_large_family(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(16)):
            copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    old = minhash.BLOCK_ROWS
    minhash.BLOCK_ROWS = 40  # several tiles
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    finally:
        minhash.BLOCK_ROWS = old
    assert got == near(dict(rows))


def test_licences(spark, empty):
    rows = [
        (0, "prose\nReleased under the MIT License.\nmore prose"),
        (1, "LICENSED under the apache license   version 2 0"),
        (2, "Permission is hereby granted, free of charge, to any person"),
        (3, None),
        (4, ""),
        (5, "word"),
        (6, "All rights reserved.\n\nLicensed under CC BY-NC 4.0.\n" * 2),
        (7, "first " + licences.TEMPLATES[5][1][:20] + "\n" + licences.TEMPLATES[-3][1]),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[0].licence, got[0].n_lines) == ("MIT", 1)
    assert (got[1].licence, got[1].dice) == ("Apache-2.0", 1.0)
    assert got[2].licence is None and got[3].licence is None and got[4].dice == 0 and got[5].licences == ""
    assert got[6].licences == "CC-BY-NC-4.0" and got[6].n_lines == 4
    assert licences.scan(empty).count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    vocabulary = tokens.word_vocabulary(path)
    for text, ids in zip(ODD, vocabulary.encode(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    held = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts())}
    rows = packing.pack(docs, path, capacity=256).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = held[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for items in sequences.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 256
    for k, items in pieces.items():
        assert sum(n for _, n in items) == len(held[k]) * (2 if k == 8 else 1)
    total = sum(n for items in sequences.values() for _, n in items)
    assert len(sequences) <= -(-total // 256) + 2
    assert packing.pack(empty, path).count() == 0


def test_best_filling():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 5) for _ in range(5)}
        capacity = rng.randrange(1, 80)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        used = packing.best_filling(counts, capacity)
        assert all(used[k] <= counts[k] for k in used)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= capacity)


def test_quality(docs, empty):
    def brute(t: str | None) -> tuple:
        t = t or ""
        w = words(t)
        where = defaultdict(list)
        for i in range(len(w) - 4):
            where[tuple(w[i : i + 5])].append(i)
        covered = {k for v in where.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
        seen, copies = set(), 0
        for line in t.split("\n"):
            if words(line):
                copies += line in seen
                seen.add(line)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), copies, len(covered), failed

    held = dict(enumerate(texts()))
    rows = quality.score(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(held[r.doc_id])
        assert not (r.kept and r.base_failed)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    assert quality.score(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_quality_model():
    n = len(quality.RULES)
    good, bad = (1,) * n, (-1, 1, 1, -1, *(1,) * (n - 4))
    model = quality.estimate([(good, 900), (bad, 60), ((0,) * n, 40)])
    assert quality.posterior_of(model, good) > 0.9 and quality.posterior_of(model, bad) < 0.1


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter", "su") for b in ("ko", "ne", "ra", "ti", "von")]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 90))]
        bad = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nastyone", "grubbling"]) + rng.choice(["", "s", ","]))
        rows.append((i, " ".join(w), "clash"))
        labels.append((i, 1, int(bad)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = spark.createDataFrame([*labels, labels[0], (5000, 1, 1), (None, 1, 1), (7, 0, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.toxic_score for r in toxicity.scored(table, toxicity.trained(table, known)).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(held) / len(held) > 0.95
    model = toxicity.fit([r[1].encode() for r in rows[:300]], np.array([y for _, _, y in labels[:300]]), epochs=2)
    for text in texts():  # a text's score doesn't depend on its neighbours
        alone = model.scores([(text or "").encode()])[0]
        assert 0 <= alone <= 1
    many = model.scores([t.encode() if t is not None else None for t in texts()])
    assert abs(many[8] - model.scores([texts()[8].encode()])[0]) < 1e-5
    none = toxicity.fit([b"a"], np.array([1]))
    assert toxicity.scored(docs, none).count() == docs.count() and toxicity.scored(empty, none).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    network = toxicity.Network()
    vectors = rng.standard_normal((9, toxicity.INPUTS)).astype(np.float32)
    at = rng.integers(0, 10, (5, 3))
    at[0] = 0
    x = np.concatenate([vectors, np.zeros((1, toxicity.INPUTS), np.float32)])[at]
    keep: dict = {}
    network.logits(network.tables(vectors), at, keep)
    found, _ = network.gradients(keep, x, np.ones(3, np.float32))
    for name in ("wf", "ub", "att", "out", "cf"):
        place = tuple(0 for _ in network.p[name].shape)
        step = 1e-2
        network.p[name][place] += step
        up = network.logits(network.tables(vectors), at).sum()
        network.p[name][place] -= 2 * step
        down = network.logits(network.tables(vectors), at).sum()
        network.p[name][place] += step
        assert abs((up - down) / (2 * step) - found[name][place]) < 2e-2, name


def test_null_ids(spark):
    line = " ".join(f"v{i}" for i in range(50))
    rows = [(None, line, None, None, None), (None, None, "en", "s", 0), (3, line + " x", None, "s", 3), (4, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash.near_duplicates(table).collect())
    assert got == [(0, 0, 0, True), (0, 49, 3, False), (3, 50, 3, True), (4, 0, 4, True)]
    none = toxicity.fit([], np.array([]))
    byte, word = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
    for made in (
        media.stored(table),
        substring.mark(table),
        hilbert.shards(table),
        bpe.digests(table, byte, public_tokenizers.PATTERN),
        licences.scan(table),
        packing.pack(table, word),
        quality.score(table),
        toxicity.scored(table, none),
    ):
        assert made.count() == 4
        assert made.where("doc_id is null").count() == 2
