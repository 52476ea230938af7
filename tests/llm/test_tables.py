"""The operators on the synthetic tables: held-out accuracy, and answers counted out in plain Python."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from partkin.llm import html_text, language_id, near_dedup, quality, queries, shared
from tests.llm.test_operators import similar_classes

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in shared.table(spark, SF, "documents").collect()}


def test_language_of_documents_it_never_saw(spark, docs):
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, SF).collect()}
    assert got.keys() == docs.keys()
    told = [(got[i]["lang_pred"], r["lang"]) for i, r in docs.items() if held(i) and r["lang"] is not None and any(c.isalpha() for c in r["text"] or "")]
    assert len(told) > 200 and np.mean([a == b for a, b in told]) > 0.97
    assert all((got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for i, r in docs.items())


def test_codes_need_no_table_of_languages(spark, docs):
    """Decoding by hand: the codeword of least weighted logistic loss, from the bits' margins alone."""
    model = language_id.learn(shared.table(spark, SF, "documents"))
    texts = [r["text"] for r in docs.values() if r["text"]][:80]
    data, at = shared.utf8(__import__("pyarrow").array(texts))
    x = language_id.features(data, at)
    for k, best in enumerate(model.decode(x)[0]):
        margins = [sum(float(v) * float(w) for v, w in zip(x[k], model.weights[:-1, bit], strict=True)) + float(model.weights[-1, bit]) for bit in range(model.code.shape[1])]
        losses = [sum(t * np.log1p(np.exp(-c * m)) for t, c, m in zip(model.trust, word, margins, strict=True)) for word in model.code]
        assert abs(losses[best] - min(losses)) < 1e-4


def test_quality_of_documents_it_never_saw(spark, docs):
    got = {r["doc_id"]: r for r in queries.op6_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in shared.table(spark, SF, "labels").collect()}
    right = [got[i]["predicted"] == q for i, q in labels.items() if held(i) and i in got]
    assert got.keys() == docs.keys() and len(right) > 50 and np.mean(right) > 0.95
    one = {r["text"]: got[i]["score"] for i, r in docs.items()}
    assert all(abs(one[r["text"]] - got[i]["score"]) < 1e-12 for i, r in docs.items())


def plain_features(text):
    """The features of one text, counted one character and one word at a time."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(quality.FEATURES)
    n = len(raw)
    share = lambda chars: sum(raw.count(ord(c)) for c in chars) / n
    stops, bars, spaces = ".,;:'\"-()", "|<>{}[]/\\", " \t\r\x0b\x0c"
    wide = sum(b >= 128 for b in raw) / n
    capitals, small, digits = (sum(a <= b <= z for b in raw) / n for a, z in ((65, 90), (97, 122), (48, 57)))
    lines = raw.count(10) / n
    known = share(stops) + share(bars) + share(spaces) + share("!?") + wide + capitals + small + digits + lines
    words = [w for w in re.split(rb"[ \t\r\x0b\x0c\n]+", raw) if w]
    m = max(len(words), 1)
    plain = set((stops + spaces + "\n").encode()) | set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
    return [
        np.log1p(n), 1 - known, share(stops), capitals, digits, share(spaces), lines, share(bars), share("!?"), wide, sum(a == b < 128 for a, b in zip(raw, raw[1:])) / n,
        min((n - round(share(spaces) * n) - raw.count(10)) / m, 50), sum(a == b for a, b in zip(words, words[1:])) / m, len(set(words)) / m, sum(any(b not in plain for b in w) for w in words) / m,
        np.log1p(len(words) / (raw.count(10) + 1)),
    ]


def test_features_of_quality_are_brute_force(docs):
    texts = [r["text"] or "" for r in docs.values()][:300]
    data, at = shared.utf8(__import__("pyarrow").array(texts))
    assert np.allclose(quality.features(data, at), [plain_features(t) for t in texts], atol=1e-9)


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(4)
    x = rng.random((600, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 2] + x[:, 5] * x[:, 7] > 0.8).astype(float), rounds=20)
    for row, score in zip(x[:50], model.scores(x[:50]), strict=True):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        logit = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[bins[i]][bins[j]] for i, j, t in model.pairs)
        assert abs(1 / (1 + np.exp(-logit)) - score) < 1e-9


def test_main_text_is_what_the_articles_say(spark):
    """On these pages each article element holds the text; its lines are found here by a pattern, not by the parser."""
    import html

    rows = shared.table(spark, SF, "pages").collect()
    got = {r["page_id"]: r["text"] for r in queries.op3_html_text(spark, SF).collect()}
    right = 0
    for r in rows:
        body = re.search(r"<article\b[^>]*>(.*?)</article>", r["html"] or "", re.S)
        if body:
            blocks = re.findall(r"<(h[1-6]|p|li|td|blockquote|pre|figcaption)\b[^>]*>(.*?)</\1>", body[1], re.S)
            words = [w for _, b in blocks for w in html.unescape(re.sub(r"<[^>]+>", "", b)).split()]
            kept = Counter(got[r["page_id"]].split())
            right += sum((Counter(words) & kept).values()) >= 0.98 * len(words)
    assert len(got) == len(rows) and right >= 0.97 * len(rows)


def test_near_copies_and_nothing_else(spark, docs):
    """All pairs at 0.8 or more are joined, and no others: precision and recall against brute force."""
    some = {i: r["text"] for i, r in docs.items()}
    want = similar_classes(some, near_dedup.SIMILAR) if len(some) <= 400 else classes_by_length(some)
    got = {r["doc_id"]: r["class_id"] for r in queries.op5_near_dedup(spark, SF).collect()}
    assert got == want


def classes_by_length(rows, least=near_dedup.SIMILAR):
    """Connected components of all pairs alike; pairs whose totals alone forbid it are left out."""
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    total = {i: sum(s.values()) if s else 0 for i, s in sets.items()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows, key=lambda i: (total[i], i))
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] is None or sets[b] is None:
                alike = sets[a] is sets[b] and (rows[a] or "") == (rows[b] or "")
            elif total[a] < least * total[b]:
                break
            else:
                both = sum(min(m, sets[b][s]) for s, m in sets[a].items() if s in sets[b])
                alike = both / (total[a] + total[b] - both) >= least
            if alike:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in rows}


def test_every_page_has_a_row(spark):
    pages = shared.table(spark, SF, "pages")
    assert html_text.extract_main_text(pages).count() == pages.count()
