"""The corpus operators on small tables: brute force, round trips, and the odd rows that each must take."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from partkin.llm import exact_dedup, fingerprints, html_text, language_id, line_dedup, mixing, near_dedup, packing, quality, shared, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, value string, bucket int, kind int, size long, score double, rep long"
LONG = "lorem ipsum dolor " * 40_000


def table(spark, rows, schema=SCHEMA, parts=3):
    """Rows of (doc_id, text, lang, source), the rest of the columns clashing names with nulls."""
    full = [(i, t, la, s, None if t is None else len(t), "x", 1, 2, 3, 0.5, 4) for i, t, la, s in rows]
    return spark.createDataFrame(full, schema).repartition(parts)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(5, 200)) for _ in range(40)]
    rows = [(k, t, "en" if k % 2 else "fr", f"s{k % 3}" if k % 7 else None) for k, t in enumerate(base)]
    shared_ = words(rng, 40)
    for k in range(40, 60):
        t = rng.choice(base)
        kind = k % 4
        if kind == 1:
            w = t.split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = words(rng, 30) + "\n" + shared_ + "\n" + words(rng, 20)
        elif kind == 3:
            t = shared_ + " " + t
        rows.append((k, t, "en", "s0"))
    return [*rows, (60, None, None, None), (61, "", "en", "s9"), (62, "  \n\t ", "en", "s0"), (63, "é ß 漢字 🙂", "fr", "s1"), (64, "!!! ###", "en", "s1"), (65, LONG, "en", "s0"), (66, LONG, "en", "s0")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus()).persist()


@pytest.fixture(scope="module")
def texts():
    return {i: t for i, t, *_ in corpus()}


def empty(spark):
    return table(spark, [])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- exact dedup ---


@pytest.mark.parametrize("least", [2, 64])
def test_exact_dedup_is_brute_force(docs, texts, least, monkeypatch):
    monkeypatch.setattr(exact_dedup.heavy_hitters, "__defaults__", (2048, 16_384, least))
    got = by_id(exact_dedup.exact_dedup(docs))
    groups = {}
    for i, t in texts.items():
        groups.setdefault(t or "", []).append(i)
    for i, t in texts.items():
        g, r = groups[t or ""], got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), i == max(g))
        assert r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_odd_tables(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    got = exact_dedup.exact_dedup(table(spark, [(1, "a", None, None), (1, "a", None, None), (None, "a", None, None)])).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == Counter([(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False)])
    got = exact_dedup.exact_dedup(table(spark, [(None, "a", None, None)] * 2)).collect()
    assert [(r["keep_id"], r["group_size"]) for r in got] == [(None, 2)] * 2 and sum(r["kept"] for r in got) == 1


# --- line dedup ---


def removed_lines(rows):
    first, out = {}, {}
    for i, t in sorted(rows.items()):
        lines = (t or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in first:
                gone |= {k, k + 1, k + 2}
            first.setdefault(window, (i, k))
        out[i] = [x for k, x in enumerate(lines) if k not in gone], len(lines), len(gone)
    return out


@pytest.mark.parametrize("least", [2, 64])
def test_line_dedup_is_brute_force(spark, least):
    rng = random.Random(1)
    rows = {k: "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for k in range(60)}
    rows |= {60: None, 61: "", 62: "\n\n\n\n", 63: "a\nb", 64: "\n".join(["x"] * 500)}
    got = by_id(line_dedup.line_dedup(table(spark, [(i, t, "en", "s") for i, t in rows.items()]), least=least))
    for i, (kept, n, gone) in removed_lines(rows).items():
        assert got[i]["text"] == (None if rows[i] is None else "\n".join(kept)), i
        assert (got[i]["n_lines"], got[i]["n_removed"]) == (n, gone)
        assert got[i]["n_chars"] == (None if rows[i] is None else len(got[i]["text"])) and got[i]["value"] == "x"


def test_line_dedup_odd_tables(spark):
    assert line_dedup.line_dedup(empty(spark)).count() == 0
    same = line_dedup.line_dedup(table(spark, [(None, "a\nb\nc", None, None), (None, "a\nb\nc", None, None)])).collect()
    assert [r["text"] for r in same] == ["a\nb\nc"] * 2


def test_line_dedup_of_tables_with_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "own", 5), (2, "x\na\nb\nc", "own", 6)], "doc_id long, text string, n_lines string, n_removed long")
    got = by_id(line_dedup.line_dedup(docs))
    assert (got[2]["text"], got[2]["n_lines"], got[2]["n_removed"]) == ("x", 4, 3)
    plain = line_dedup.line_dedup(docs, counts=False)
    assert plain.columns == docs.columns and by_id(plain)[2] == (2, "x", "own", 6)


def test_plans_of_native_operators_have_no_python(docs, capsys):
    for df in (line_dedup.line_dedup(docs), exact_dedup.exact_dedup(docs)):
        df.explain()
        assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


# --- near dedup ---


def similar_classes(rows, least):
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x is None or y is None:
                alike = x is y and (rows[a] or "") == (rows[b] or "")
            else:
                both = sum((x & y).values())
                alike = both / (sum(x.values()) + sum(y.values()) - both) >= least
            if alike:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in rows}


def test_near_dedup_is_brute_force(docs, texts):
    got = by_id(near_dedup.near_dedup(docs))
    want = similar_classes(texts, 0.8)
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[want[i]] and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_dedup_large_bucket_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = words(rng, 300).split()
    rows = {}
    for k in range(60):
        w = list(base)
        w[rng.randrange(300)] = f"x{k}"
        rows[k] = " ".join(w)
    rows |= {100 + k: words(rng, 80) for k in range(20)}
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    got = by_id(near_dedup.near_dedup(table(spark, [(i, t, "en", "s") for i, t in rows.items()])))
    assert {r["class_id"] for i, r in got.items() if i < 60} == {0} and all(r["class_id"] == i for i, r in got.items() if i >= 100)


@pytest.mark.parametrize("block", [1000, 4])
def test_near_dedup_has_a_sharp_border(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng, rows = random.Random(11), {}
    for k in range(60):  # pairs of n shingles that share m: from 0.74 to 0.85, and 0.8 itself
        n, m = 180, (153, 155, 157, 158, 159, 160, 161, 162, 165)[k % 9]
        w = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
        rows[2 * k], rows[2 * k + 1] = " ".join(w), " ".join(w[: m + 4] + [f"v{rng.randrange(10**9)}" for _ in range(n - m)])
    w = [f"u{k}" for k in range(184)]  # a group about one text, whose members are not alike among themselves
    rows |= {500 + k: " ".join(w[: 150 + 2 * k + 4] + [f"x{k}y{j}" for j in range(30 - 2 * k)]) for k in range(10)}
    got = by_id(near_dedup.near_dedup(table(spark, [(i, t, "en", "s") for i, t in rows.items()])))
    assert {i: r["class_id"] for i, r in got.items()} == similar_classes(rows, 0.8)


def test_near_dedup_odd_tables(spark):
    assert near_dedup.near_dedup(empty(spark)).count() == 0
    got = near_dedup.near_dedup(table(spark, [(None, "a b", None, None), (3, "A, b!", None, None), (3, "a b", None, None), (9, "a b", None, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (3, 3, False), (3, 3, True), (9, 3, False)]


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(2)
    w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    for share in (0.2, 0.5, 0.9):
        keep = int(400 * share)
        text = [" ".join(w).encode(), " ".join(w[:keep] + [f"v{k}" for k in range(400 - keep)]).encode()]
        data, at = np.frombuffer(b"".join(text), np.uint8), np.array([0, len(text[0]), len(text[0]) + len(text[1])])
        marks = near_dedup.signatures(*near_dedup.shingles(data, at)).astype(np.uint8)
        true = (keep - 4) / (2 * 396 - (keep - 4))
        assert abs(near_dedup.estimates(marks[0], marks[1]) - true) < 0.1


def test_signatures_estimate_weighted_sets():
    rng = np.random.default_rng(5)
    items = np.sort(rng.integers(1, 1 << 62, 60).astype(np.uint64))
    for scale in (0.4, 1.0, 30.0):  # weights below one, about it and large, none of them whole
        one, two = rng.random(60) * scale * 2, rng.random(60) * scale * 2
        row = np.repeat([0, 1], 60)
        marks = near_dedup.signatures(np.tile(items, 2), row, np.concatenate([one, two]), np.array([one.sum(), two.sum()]), 4000).astype(np.uint8)
        assert abs(near_dedup.estimates(marks[0], marks[1]) - np.minimum(one, two).sum() / np.maximum(one, two).sum()) < 0.05


def test_near_dedup_counts_how_often_shingles_occur(spark):
    line = "one two three four five six seven "
    rows = {k: line * n + "end of it all here now" for k, n in enumerate((100, 118, 121, 150, 400, 480, 900, 1150))}
    got = by_id(near_dedup.near_dedup(table(spark, [(i, t, "en", "s") for i, t in rows.items()])))
    assert {i: r["class_id"] for i, r in got.items()} == similar_classes(rows, 0.8)


def test_near_dedup_finds_what_is_outside_the_largest_class(spark, monkeypatch):
    """Signatures of one band of one row, so that buckets hold many texts that are not alike."""
    for name, value in (("BLOCK", 5), ("LEADERS", 2)):
        monkeypatch.setattr(near_dedup, name, value)
    rng, rows = random.Random(31), {}
    common = [f"c{k}" for k in range(60)]
    for k in range(40):  # a third of each is common, so they meet but are not alike
        own = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        rows[2 * k] = " ".join(common + own)
        rows[2 * k + 1] = " ".join(common + own[:-3] + ["x", "y", "z"])
    rows |= {200 + k: " ".join(common + [f"v{j}" for j in range(100)] + [f"u{k}"]) for k in range(30)}
    got = by_id(near_dedup.near_dedup(table(spark, [(i, t, "en", "s") for i, t in rows.items()])))
    assert {i: r["class_id"] for i, r in got.items()} == similar_classes(rows, 0.8)


def test_without_near_copies_keeps_one_row_a_class(spark):
    rows = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "g h i j k l", "en", "s"), (2, "A b c d e f!", "fr", "s"), (3, "g h i j k l", "en", "t"), (3, "g h i j k l", "en", "t"), (None, "a b c d e f", "en", "s")]
    for given in (rows, rows[3:]):
        left = near_dedup.without_near_copies(table(spark, given))
        assert left.columns == table(spark, given).columns
        want = Counter({(1, "a b c d e f"): 1, (1, "g h i j k l"): 1, (None, "a b c d e f"): 1}) if given is rows else Counter({(2, "A b c d e f!"): 1, (3, "g h i j k l"): 1, (None, "a b c d e f"): 1})
        assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == want


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201)]
    got = {r["id"]: r["class_id"] for r in near_dedup.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[100 + k] for k in range(30)} == {100} and got[201] == 200


# --- substring dedup ---


def removed_bytes(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(b[k : k + length])
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + (len(b) and gone[0]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("length,gram,buckets", [(100, 24, None), (30, 8, 5)])
def test_substring_dedup_is_brute_force(spark, length, gram, buckets):
    rows = {i: t if t != LONG else LONG[:3000] for i, t, *_ in corpus(8)}
    rows |= {70: "ab" * 300, 71: "b" + "ab" * 100, 72: "é" * 200, 73: rows[1] + rows[2]}
    got = by_id(substring_dedup.substring_dedup(table(spark, [(i, t, "en", "s") for i, t in rows.items()]), length, gram, buckets))
    want = removed_bytes(rows, length)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


@pytest.mark.parametrize("parts", [1, 3])
def test_substring_dedup_of_repeated_rows(spark, parts):
    rng = random.Random(12)
    rows = {5: words(rng, 80), 7: words(rng, 90)}
    rows |= {6: rows[5][100:350] + words(rng, 40), 8: rows[7][:200] * 2 + words(rng, 30), 9: rows[5]}
    rows[3] = words(rng, 20) + rows[7][50:250]
    want = removed_bytes(rows, 100)
    got = substring_dedup.substring_dedup(table(spark, [(i, t, "en", "s") for i, t in rows.items()] * 3, parts=parts)).collect()
    assert len(got) == 18 and want[5][1] == 0 < want[8][1]
    assert {(r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got} == set(want.items())


def test_substring_dedup_of_other_texts_under_one_id(spark):
    rng = random.Random(15)
    a, b, c = words(rng, 60), words(rng, 60), words(rng, 60)
    rows = [(1, a + b[:200]), (1, b), (1, b), (2, a[50:250] + c), (2, c + b[100:300]), (3, c), (None, a)]
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ranked = sorted({(i, hashed[t], t) for i, t in rows if i is not None})
    want = removed_bytes({k: t for k, (_, _, t) in enumerate(ranked)}, 100)
    want = Counter({(i, *want[k]): sum((i, t) == r for r in rows) for k, (i, _, t) in enumerate(ranked)})
    want[(None, len(a), 0, 0, hashlib.sha256(a.encode()).hexdigest())] = 1
    got = substring_dedup.substring_dedup(docs).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == want


def test_substring_dedup_odd_tables(spark):
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
    got = substring_dedup.substring_dedup(table(spark, [(None, "x" * 300, None, None), (5, "y" * 99, None, None)])).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == [(99, 0), (300, 0)]


@pytest.mark.parametrize("least", [3, 40])
def test_substring_dedup_splits_what_is_too_common(spark, least):
    rng = random.Random(21)
    mark, line = words(rng, 9)[:24], words(rng, 30)[:70]  # a string of 24 bytes in every document, and one of 70
    rows = {k: words(rng, 20) + mark + words(rng, 20) + " " + line + words(rng, 25) for k in range(60)}
    rows |= {100 + k: words(rng, 5) + rows[k][60:400] + words(rng, 5) + mark + "é" * 60 for k in range(0, 60, 7)}
    docs = table(spark, [(i, t, "en", "s") for i, t in rows.items()])
    named = docs.select("doc_id", "text")
    anchors, strings = (*substring_dedup.too_common(named, 40_000, 100, 24, 1 << 16, least), ())[:2]
    assert len(anchors) > 0 and (least > 3 or len(strings) > 0)
    got = by_id(substring_dedup.substring_dedup(docs, least=least))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == removed_bytes(rows, 100)


def test_segments_are_the_same_wherever_they_stand():
    rng = random.Random(4)
    text, before = words(rng, 90).encode(), words(rng, 33).encode()
    alone = substring_dedup.segments(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 100, 24)
    both = np.frombuffer(before + text, np.uint8)
    after = substring_dedup.segments(both, np.array([0, len(before), len(both)]), 100, 24)
    assert sorted(zip(*[x.tolist() for x in (alone[0], alone[1], *alone[3:])])) == sorted(t for t, r in zip(zip(*[x.tolist() for x in (after[0], after[1], *after[3:])]), after[2], strict=True) if r == 1)


def test_misra_gries_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(2)
    keys = np.concatenate([np.full(900, 7), np.full(400, 9), rng.integers(100, 10**6, 5000)]).astype(np.uint64)
    rng.shuffle(keys)
    held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in np.array_split(keys, 13):
        held, counts = substring_dedup.summary(np.concatenate([held, part]), np.concatenate([counts, np.ones(len(part), np.int64)]), 50)
        assert len(held) <= 50
    found = dict(zip(held.tolist(), counts.tolist(), strict=True))
    assert 900 - len(keys) / 50 <= found[7] <= 900 and 400 - len(keys) / 50 <= found[9] <= 400


def test_equal_hashes_of_different_bytes_are_told_apart():
    body = np.frombuffer(b"aaaabbbbaaaabbbb", np.uint8)
    key = substring_dedup._told_apart(np.array([5, 5, 5, 9], np.uint64), np.array([0, 4, 8, 12]), body, 4)
    assert key[0] == key[2] != key[1] and len(set(key.tolist())) == 3


def test_segments_of_a_long_text_cover_each_window_once():
    data = np.frombuffer(random.Random(1).randbytes(9_000_000), np.uint8)
    _, _, _, start, windows, _ = substring_dedup.segments(data, np.array([0, len(data)]), 100, 24)
    order = np.argsort(start)
    assert start[order][0] == 0 and (start[order][1:] == (start + windows)[order][:-1]).all() and (start + windows).max() == len(data) - 99


# --- packing ---


@pytest.mark.parametrize("file,chunk", [("word_bpe_49k.json", 1024), ("word_bpe_49k.json", 50), ("byte_bpe_50k.json", 1024)])
def test_packing_is_a_round_trip(docs, texts, file, chunk, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CHUNK", chunk)
    model = Tokenizer.from_file(public_tokenizers.path(file))
    pieces = packing.pack(docs, public_tokenizers.path(file), length=256).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == texts.keys()
    for i, t in texts.items():
        ids, at = [*model.encode(t or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            part = np.array(ids[at : at + p["length"]], "<u4")
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += p["length"]
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256 and at & (at - 1) == 0


def test_encoder_is_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, model, rng = packing.Encoder(path), Tokenizer.from_file(path), random.Random(4)
    letters = "aAbBzé É'srtvemldSLVR  \n\t.,!?#1²½ßŒÿªºµıçñ09_-ŉÅ''İΣς漢🙂́\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["it's we'll I'VE 'S ''s", "a <|endoftext|> b", "'", ""]
    ids, sizes = encode(texts)
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_packing_odd_tables(spark):
    assert packing.pack(empty(spark)).count() == 0
    got = packing.pack(table(spark, [(1, None, None, None), (1, None, None, None), (None, "a", None, None)])).collect()
    assert sorted((r["doc_tokens"], r["length"]) for r in got)[:2] == [(1, 1), (1, 1)]


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,0)", "int"])
def test_packing_of_other_integers_and_repeated_rows(spark, kind, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 8)
    text = "some words that make more than a chunk of tokens, " * 4
    docs = table(spark, [(1, text, None, None)] * 3 + [(1, "other " + text, None, None)]).withColumn("doc_id", F.col("doc_id").cast(kind))
    got = packing.pack(docs, length=64)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert got.agg(F.sum("length")).first()[0] == docs.count() * got.agg(F.min("doc_tokens")).first()[0] + 1 and got.where("doc_id = 1").count() == got.count()


def test_words_that_share_a_hash_are_encoded_whole(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, odd = packing.Encoder(path), packing.Encoder(path)
    monkeypatch.setattr(odd, "words", lambda t, words=odd.words: (lambda s, n, h, c: (s, n, h % np.uint64(5), c))(*words(t)))
    texts = ["these are several words of a text", "and these of another"]
    assert all((a == b).all() for a, b in zip(plain(texts), odd(texts), strict=True))


# --- mixing ---


def by_rounds(sizes, weights, share, epochs):
    """Targets by sharing the excess again and again."""
    targets, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    total = share * sizes.sum()
    while True:
        left = total - targets[~open_].sum()
        if not open_.any() or left <= 0:
            return targets
        targets[open_] = weights[open_] * left / weights[open_].sum()
        over = open_ & (targets > epochs * sizes + 1e-9)
        if not over.any():
            return targets
        targets[over] = epochs * sizes[over]
        open_ &= ~over


def test_water_level_and_apportionment():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        sizes = rng.integers(0, 1000, n).astype(float)
        weights = np.array([(5.0, 2.0, 1.0)[k % 3] for k in range(n)])
        assert np.allclose(mixing.water_level(sizes, weights, 1.5, 2), by_rounds(sizes, weights, 1.5, 2))
        votes, seats, most = rng.integers(0, 50, n).astype(float), int(rng.integers(0, 40)), rng.integers(0, 20, n)
        want = np.zeros(n, int)
        for _ in range(int(min(seats, most[votes > 0].sum()))):
            open_ = (want < most) & (votes > 0)
            want[np.argmax(np.where(open_, votes / (2 * want + 1), -1))] += 1
        assert mixing.sainte_lague(votes, seats, most).tolist() == want.tolist()


def test_mix(docs, texts):
    got = by_id(mixing.mix(docs, shard_docs=4))
    assert got.keys() == texts.keys()
    sizes = {i: len((t or "").encode().split()) for i, t in texts.items()}
    source = {i: s for i, _, _, s in corpus()}
    names = sorted({s for s in source.values()}, key=lambda s: (s is None, s or ""))
    total = np.array([sum(sizes[i] for i in sizes if source[i] == s) for s in names])
    target = by_rounds(total.astype(float), np.array([(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))]), 1.5, 2)
    for i, r in got.items():
        k = names.index(source[i])
        assert r["size"] == sizes[i] and r["source_size"] == total[k] and abs(r["target"] - target[k]) < 1e-6 and 0 <= r["taken"] <= 2 * sizes[i]
    for k, s in enumerate(names):
        assert abs(sum(r["taken"] for i, r in got.items() if source[i] == s) - target[k]) <= max(0.02 * target[k], 2)
    again = by_id(mixing.mix(docs.repartition(7), shard_docs=4))
    assert {i: r["taken"] for i, r in again.items()} == {i: r["taken"] for i, r in got.items()}


def placed_by_hand(rows, quota, block, seed=17):
    """taken of every row of one shard: documents in order of their hash, whole passes, then the first words left."""
    hashed = {i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in rows}
    total = sum(rows.values())
    take, out = min(quota * block, 2 * total), {}
    left = take % total
    for i in sorted(rows, key=lambda i: (hashed[i], i)):
        part = min(rows[i], left)
        out[i], left = take // total * rows[i] + part, left - part
    return out


def test_mix_takes_each_document_in_its_turn(spark):
    rng = random.Random(8)
    rows = [(k, words(rng, rng.randint(1, 90)), "en", "a" if k % 3 else "b") for k in range(90)]
    got = by_id(mixing.mix(table(spark, rows), block_words=7))
    sizes = {s: {i: len(t.split()) for i, t, _, x in rows if x == s} for s in "ab"}
    total = np.array([sum(sizes[s].values()) for s in "ab"], float)
    target = by_rounds(total, np.array([5.0, 2.0]), 1.5, 2)
    blocks = mixing.sainte_lague(target, int(round(target.sum() / 7)))
    for k, s in enumerate("ab"):
        want = placed_by_hand(sizes[s], min(int(blocks[k]), int(-(-2 * total[k] // 7))), 7)
        assert {i: got[i]["taken"] for i in want} == want


@pytest.mark.parametrize("shard_docs", [2, 5])
def test_mix_of_many_shards_in_groups(spark, shard_docs):
    rng = random.Random(18)
    rows = [(k, words(rng, rng.randint(1, 40)), "en", f"s{k % 2}") for k in range(200)]
    got = by_id(mixing.mix(table(spark, rows), shard_docs=shard_docs, block_words=3))
    for s in ("s0", "s1"):
        own = [r for r in got.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] + 3 and all(0 <= r["taken"] <= 2 * r["size"] for r in own)


def test_mix_of_repeated_rows(spark):
    text = "w " * 60
    rows = [(1, text, "en", "a")] * 2 + [(1, "v " * 30, "en", "a"), (2, "u " * 50, "en", "b"), (None, "t " * 20, "en", "b")]
    docs = table(spark, rows)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
    real = Counter()
    for r in mixing.mixed(docs).collect():
        real[r["source"]] += len(r["text"].split())
    targets = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    assert taken == real and all(abs(real[s] - t) <= 2 for s, t in targets.items())


def test_realised_mix_has_the_words_taken(docs, texts):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = Counter()
    for r in mixing.mixed(docs).collect():
        got[r["doc_id"]] += len((r["text"] or "").encode().split())
        assert (texts[r["doc_id"]] or "").startswith(r["text"] or "") and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in got.items() if n}


def test_mix_odd_tables(spark):
    assert mixing.mix(empty(spark)).count() == 0
    got = mixing.mix(table(spark, [(1, None, None, None), (2, "  ", None, "a")])).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in got} == {(0, 0.0, 0)}


# --- fingerprints ---


def test_fingerprints_and_edited_texts(docs, texts):
    got = by_id(fingerprints.document_fingerprints(docs, buckets=5))
    ids = sorted(texts)
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        alone = fingerprints.fingerprints([text.encode(), edited.encode()])
        assert [r["fingerprint"], r["edited_fingerprint"]] == alone.strings()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[65]["near_next"] == 1.0  # the same long text twice
    usual = [r["near_edited"] for i, r in got.items() if r["n_chars"] > 500 and i < 60]
    assert np.mean(usual) > 0.6 and np.mean([got[i]["near_next"] for i in range(39)]) < 0.05


def mixed64(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ (x >> shift)) * factor) & (1 << 64) - 1
    return x


def piecewise(text):
    """The fingerprint of one text, a byte at a time: (block, signature, signature at twice the block)."""
    whole, power, prime = (1 << 64) - 1, 0x9FB21C651E98DF25, 0x01000193

    def rolled(k):  # of the seven bytes that end at k; before the text there are zeros
        x = sum(((text[k - j] if k >= j else 0) + 1) * pow(prime, j, 1 << 32) for j in range(7)) & 0xFFFFFFFF
        x = ((x ^ (x >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF
        return x ^ (x >> 13)

    rolls = [rolled(k) for k in range(len(text))]

    def signature(block):
        out, start = [], 0
        for k in range(len(text)):
            if k == len(text) - 1 or (rolls[k] % block == block - 1 and len(out) < 63):
                total = sum(mixed64((b + 1) * 0xD6E8FEB86659FD93 & whole) * pow(power, n, 1 << 64) for n, b in enumerate(text[start : k + 1])) & whole
                out.append(chr(fingerprints.ALPHABET[mixed64(total) >> 58]))
                start = k + 1
        return "".join(out)

    block = 3
    while block * 64 < len(text):
        block *= 2
    while block > 3 and len(signature(block)) < 32:
        block //= 2
    return block, signature(block), signature(2 * block)


def alike_by_hand(a, b):
    def one(x, y):
        need = min(7, (max(len(x), len(y)) + 1) // 2)
        run = any(x[k : k + need] in y for k in range(len(x) - need + 1))
        return 2 * common_subsequence(x, y) / (len(x) + len(y)) if run and x + y else 0.0

    if a[0] == b[0]:
        return 1.0 if not a[1] and not b[1] else max(one(a[1], b[1]), one(a[2], b[2]))
    return one(a[1], b[2]) if a[0] == 2 * b[0] else one(a[2], b[1]) if 2 * a[0] == b[0] else 0.0


def test_fingerprints_are_brute_force(spark):
    rng = random.Random(17)
    texts = [words(rng, n) for n in (1, 2, 5, 30, 31, 60, 61, 200, 400)] + ["", "é漢字🙂" * 30, "the same line\n" * 60, "ab" * 700]
    texts.insert(5, texts[4][:90] + " changed " + texts[4][90:])
    got = by_id(fingerprints.document_fingerprints(table(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])))
    prints = [piecewise(t.encode()) for t in texts]
    for k, t in enumerate(texts):
        after, n = texts[(k + 1) % len(texts)], len(t) // 4
        edited = piecewise((t[: len(t) - n] + after[:n]).encode())
        r = got[k]
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("{}:{}:{}".format(*p) for p in (prints[k], edited)), k
        assert abs(r["near_edited"] - alike_by_hand(prints[k], edited)) < 1e-12 and abs(r["near_next"] - alike_by_hand(prints[k], prints[(k + 1) % len(texts)])) < 1e-12


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for k, y in enumerate(b):
        out.append(row[k] + 1 if x == y else max(row[k + 1], out[-1]))
    return out


def test_likeness_is_the_edit_distance():
    rng = random.Random(6)
    pairs = []
    for _ in range(200):
        a = [rng.randrange(8) for _ in range(rng.randint(0, 64))]
        b = a[: rng.randint(0, len(a))] + [rng.randrange(8) for _ in range(rng.randint(0, 20))]
        pairs.append((a, b[:64]))
    pad = lambda rows: np.array([r + [0] * (64 - len(r)) for r in rows], np.uint8)
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    got = fingerprints._alike(pad(a), np.array([len(x) for x in a]), pad(b), np.array([len(x) for x in b]))
    for x, y, g in zip(a, b, got, strict=True):
        need = min(7, (max(len(x), len(y)) + 1) // 2)
        run = any(x[i : i + need] == y[j : j + need] for i in range(len(x) - need + 1) for j in range(len(y) - need + 1))
        want = 2 * common_subsequence(x, y) / (len(x) + len(y)) if run and x + y else 0.0
        assert abs(g - want) < 1e-12


def test_texts_of_few_windows_have_long_signatures():
    rng = random.Random(13)
    texts = [LONG, "buy now " * 900, "\n".join(["the same line of the menu"] * 400), " ".join(["one two three four five"] * 300)]
    edited = [t[: len(t) // 2] + words(rng, 5) + t[len(t) // 2 :] for t in texts]
    one, two = (fingerprints.fingerprints([t.encode() for t in x]) for x in (texts, edited))
    assert ((one.one_size >= 32) | (one.block == fingerprints.SMALLEST)).all() and (one.one_size > 8).all()
    assert (fingerprints.likeness(one, two) > 0.4).all()
    alone = [fingerprints.fingerprints([t.encode()]).strings()[0] for t in texts]
    assert one.strings() == alone


def test_fingerprints_odd_tables(spark):
    assert fingerprints.document_fingerprints(empty(spark)).count() == 0
    one = fingerprints.document_fingerprints(table(spark, [(7, "abcdefgh", None, None)])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    twice = fingerprints.document_fingerprints(table(spark, [(7, "b", None, None), (7, "a", None, None), (None, "c", None, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in twice) == [(-1, 1), (7, 1), (7, 1)]
    nameless = fingerprints.document_fingerprints(table(spark, [(None, "c" * 9, None, None), (None, "d" * 9, None, None)])).collect()
    assert {(r["near_next"], r["edited_sha256"]) for r in nameless} == {(1.0, hashlib.sha256(x * 9).hexdigest()) for x in (b"c", b"d")}


# --- language ---


def languages(n=240):
    rng = random.Random(7)
    stems = {"en": ["the", "tion", "ing", "and", "er"], "fr": ["eau", "é", "ou", "que", "ç"], "de": ["sch", "ung", "ü", "ei", "ich"], "es": ["ción", "ñ", "os", "ado", "ll"]}
    rows = []
    for k in range(n):
        lang = list(stems)[k % 4]
        rows.append((k, " ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(30)), lang, "s"))
    return rows


def test_language_of_held_out_documents(spark):
    rows = languages()
    got = by_id(language_id.identify_language(table(spark, [*rows, (900, None, "en", "s"), (901, "12 !! ", "en", "s"), (902, LONG, None, "s"), (903, "Ж", None, "s")])))
    fold = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got}
    assert {i: r["held_out"] for i, r in got.items()} == fold
    assert np.mean([got[i]["lang_pred"] == la for i, _, la, _ in rows if fold[i]]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901)] == ["und", "und"] and got[900]["score"] == 0 and got[903]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_ignores_what_it_must(spark):
    rows = languages(120)
    odd = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else la, "other") for i, t, la, _ in rows]
    one, two = (by_id(language_id.identify_language(table(spark, r))) for r in (rows, odd))
    assert {i: (r["lang_pred"], r["score"]) for i, r in one.items()} == {i: (r["lang_pred"], r["score"]) for i, r in two.items()}


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        code = language_id.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 99
        assert apart.min() >= {2: 1, 3: 2, 4: 4, 7: 32}.get(n, 8)


def test_language_odd_tables(spark):
    assert language_id.identify_language(empty(spark)).count() == 0
    got = language_id.identify_language(table(spark, [(1, "abc", None, None)])).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)
    only = language_id.identify_language(table(spark, [(1, "abc", "en", None)])).first()
    assert only["lang_pred"] == "en"


# --- quality ---


def graded(n=400):
    rng, rows, labels = random.Random(9), [], []
    for k in range(n):
        good = k % 3 != 0
        t = words(rng, 60)
        rows.append((k, t.capitalize() + "." if good else "### ".join(t.split()[:30]) if k % 2 else " ".join(["spam"] * 50), "en", "s"))
        if k % 5:
            labels.append((k, int(good)))
    return rows, labels


def test_quality_of_held_out_documents(spark):
    rows, labels = graded()
    table_ = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    got = by_id(quality.score_quality(table(spark, [*rows, (900, None, None, None), (901, "", None, None), (902, LONG, None, None)]), table_))
    held = [i for i, r in got.items() if r["held_out"] and i < 900]
    assert len(held) > 50 and np.mean([got[i]["predicted"] == int(i % 3 != 0) for i in held]) > 0.95
    assert got[900]["score"] == got[901]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_quality_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(empty(spark), none).count() == 0
    assert quality.score_quality(table(spark, [(1, "a", None, None)]), none).first()["score"] == 0.5


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9


def test_features_do_not_depend_on_neighbours():
    texts = [t.encode() for t in ("One two two.\nThree ### four", "", "  ", "aaa|bbb!!")]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = quality.features(np.frombuffer(b"".join(texts), np.uint8), at)
    alone = [quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(whole, np.array(alone))


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href=/a>Menu one</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><article><header><h1>Head&amp;line</h1></header>
<p><b>First  &eacute;&#33; line<br><p>Second
line with <a href=x>a link</a>.</p><p>Third.</p><form><input value=x>Name</form><aside>Related</aside></article>
<section class="comments"><p>I think so too, said a reader at length.</p></section><footer>&copy; x</footer>"""


@pytest.mark.parametrize(
    "page,text",
    [
        (PAGE, "Head&line\nFirst é! line\nSecond line with a link.\nThird."), (None, ""), ("", ""), ("<p></p>", ""), ("plain &lt;text&gt;", "plain <text>"),
        ("<article><p>cut off in a par", "cut off in a par"), ("<article><p>one</p></article><p>two</p><article>three</article>", "one\nthree"),
        ("<div><a href=1>l1</a> <a href=2>l2</a></div><div><p>" + "Prose of some length that goes on. " * 9 + "</p></div><div><a href=3>l3</a></div>", ("Prose of some length that goes on. " * 9).strip()),
        ('<div class="page with-sidebar"><nav>m</nav><article><p>all of it</p></article></div>', "all of it"),
        ('<article><p>seen</p><p hidden>not</p><div style="display: none">nor</div><div class="commentList">said</div></article>', "seen"),
        ("<b>" * 3000 + "deep" + "</p>" * 3000, "deep"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def prose(n, word="word"):
    return (f"{word} " * n)[:n].strip()


def test_a_teaser_article_does_not_stand_for_the_page():
    main = [prose(300 + k, f"main{k}") for k in range(6)]
    card = '<article class="teaser"><h3>Next</h3><p>' + prose(90, "card") + "</p></article>"
    for page in (f"<main>{''.join(f'<p>{t}</p>' for t in main)}</main>{card}", f"{card}<div>{''.join(f'<p>{t}</p>' for t in main)}</div>"):
        got = html_text.main_text(page).split("\n")
        assert [t for t in got if t.startswith("main")] == main


@pytest.mark.parametrize(
    "page,lines",
    [
        ('<article><h2 id="search">Search</h2><p>%s</p><section id="related-work"><h2>Older</h2><p>%s</p></section></article>', ["Search", "Older"]),
        ('<article><h2 id="market-share">Share</h2><p>%s</p><section id="naval-history"><p>%s</p></section></article>', ["Share"]),
        ('<article><div class="article-header"><h1>Title</h1></div><p>%s</p><p>%s</p></article>', ["Title"]),
        ('<div class="layout with-sidebar"><article><p>%s</p><p>%s</p></article></div><div>Company 2024</div>', []),
        ('<div class="layout with-sidebar"><div><p>%s</p><p>%s</p></div><div class="sidebar"><p>Aside of it all</p></div></div><div><a href=x>Company</a></div>', []),
        ('<article><p>%s</p><p>%s</p></article><div class="comments"><article>' + prose(900, "said") + "</article></div>", []),
        ('<article><p>%s</p><p>%s</p></article><article class="comment"><p>' + prose(300, "said") + "</p></article>", []),
        ('<article class="post has-comments"><p>%s</p><p>%s</p><article id="c1" class="depth-1 comment-body">' + prose(300, "said") + "</article></article>", []),
        ('<article><p class="commentary">%s</p><div class="related-work">%s</div></article>', []),
    ],
)
def test_names_that_are_not_meant_as_hints(page, lines):
    texts = [prose(200, "first"), prose(150, "second")]
    got = html_text.main_text(page % tuple(texts)).split("\n")
    assert [t for t in got if t not in texts] == lines and [t for t in got if t in texts] == texts


@pytest.mark.parametrize("sizes", [[200] * 4 + [20_000] + [200] * 6, [60, 400, 300, 3000, 250, 60, 300, 250, 200, 150, 120], [500] * 3 + [12] * 9 + [500] * 3])
def test_paragraphs_without_an_article_stay_whatever_their_neighbours(sizes):
    texts = [prose(n) for n in sizes]
    menu = "".join(f"<div><a href=/{k}>link {k}</a></div>" for k in range(8))
    page = menu + "".join(f"<p>{t}</p>" for t in texts) + menu
    assert html_text.main_text(page).split("\n") == texts


def test_without_its_ratios_the_operator_fails(monkeypatch):
    """No element and no name tells these lines apart: what is left of them is the ratios' choice."""
    texts = [prose(280, f"text{k}") for k in range(5)]
    box = "".join(f"<div><span>tag {k}</span> <b>{k}</b> <a href=/{k}>more {k}</a></div>" for k in range(14))
    page = box + "".join(f"<p>{t}</p>" for t in texts) + box
    assert html_text.main_text(page).split("\n") == texts
    monkeypatch.setattr(html_text.np, "log1p", lambda x: np.zeros_like(np.asarray(x, float)))
    assert html_text.main_text(page).split("\n") != texts


def test_short_paragraphs_between_long_ones_stay():
    texts = [prose(200), "Yes.", prose(250), "No!", prose(180)]
    menu = "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(9))
    assert html_text.main_text(f"<ul>{menu}</ul>" + "".join(f"<p>{t}</p>" for t in texts) + f"<ul>{menu}</ul>").split("\n") == texts


def test_short_lines_far_from_prose_go():
    texts = [prose(300) for _ in range(6)]
    got = html_text.main_text("".join(f"<div>Menu {k}</div>" for k in range(12)) + "".join(f"<p>{t}</p>" for t in texts)).split("\n")
    assert [t for t in got if t in texts] == texts and len(got) <= 8


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_main_text(pages).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def test_steps_keep_rows_whole():
    at = np.array([0, 5, 5, 100, 101, 102])
    assert list(shared.steps(at, 10)) == [(0, 2), (2, 3), (3, 5)]
