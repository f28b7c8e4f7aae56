"""Language identification against a plain reading: training and scores of every text by dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loadlens.llm import langid
from loadlens.llm.queries import QUERIES
from tests.conftest import SF


def words_of(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def pieces(word, n):
    whole = f"_{word}_" if n > 1 else word
    return [whole[i : i + n] for i in range(len(whole) - n + 1)]


def plain_predictions(rows):
    part = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4
    seen = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if part(doc_id) != 2 and lang is not None and text is not None:
            for w in words_of(text):
                seen[lang, 0][w] += 1
                for n in range(1, langid.LONGEST + 1):
                    seen[lang, n].update(pieces(w, n))
    langs = sorted({lang for lang, _ in seen})
    most = {0: langid.TOP_WORDS, **langid.TOP_GRAMS}
    kept = {k: dict(sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: most[k[1]]]) for k, c in seen.items()}
    size = {k: (sum(c.values()), len(c)) for k, c in seen.items()}
    units = {n: set().union(*[kept.get((x, n), {}) for x in langs]) for n in range(langid.LONGEST + 1)} if langs else {}

    def row(unit, n):
        out = []
        for x in langs:
            total, kinds = size.get((x, n), (0, 0))
            out.append(math.log((kept.get((x, n), {}).get(unit, 0) + langid.SMOOTHING) / (total + langid.SMOOTHING * (kinds + 1))))
        return out

    def score(word):
        if word in units[0]:
            return row(word, 0)
        for n in range(langid.LONGEST, 0, -1):
            known = [row(g, n) for g in pieces(word, n) if g in units[n]]
            if known:
                return [sum(c) / len(known) for c in zip(*known, strict=True)]
        return [0.0] * len(langs)

    for doc_id, text, _ in rows:
        found = words_of(text)
        if not found or not langs:
            yield doc_id, part(doc_id) == 2, {"und": 1.0}, 0.0
            continue
        sums = [sum(c) for c in zip(*[[n * v for v in score(w)] for w, n in Counter(found).items()], strict=True)]
        top = max(sums)
        shares = [math.exp(max(-700, s - top)) for s in sums]
        yield doc_id, part(doc_id) == 2, {x: s / sum(shares) for x, s in zip(langs, shares, strict=True)}, max(shares) / sum(shares)


@pytest.mark.parametrize("sf_dir", [SF, "edge", "none"])
def test_query_equals_a_plain_reading(spark, edge, sf_dir):
    at = edge["full"] if sf_dir == "edge" else edge["none"] if sf_dir == "none" else sf_dir
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "lang").collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(plain_predictions(rows), key=key)
    got = sorted((tuple(r) for r in QUERIES["op8_langid"](spark, at).select("doc_id", "held_out", "lang_pred", "score").collect()), key=key)
    assert len(got) == len(want) == len(rows)
    for (i, held, lang, score), (j, held_out, shares, best) in zip(got, want, strict=True):
        assert (i, held) == (j, held_out) and shares[lang] == pytest.approx(max(shares.values()), abs=1e-3) and score == pytest.approx(best, abs=1e-3)
