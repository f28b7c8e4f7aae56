"""License scans against plain phrase search, and texts that differ from their template."""

import random
import re

import pytest

from loadlens.llm import licenses
from loadlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(words):
    found = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return found


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}


@pytest.mark.parametrize("sf_dir", [SF, "edge"])
def test_base_equals_a_plain_search(spark, edge, sf_dir):
    at = edge["full"] if sf_dir == "edge" else sf_dir
    got = sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in QUERIES["op11_licenses"](spark, at).collect())
    want = []
    for doc_id, text in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect():
        words = plain_words(text)
        found = plain_base(words)
        places = [i for i, _ in found]
        want.append(str((doc_id, len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found})))))
    assert got == sorted(want)


def test_neighbouring_places_all_count(spark):
    got = scanned(spark, ["CC BY cc by, CC-BY Apache\nLicense", "ccby cc-bye", None, "cc", "MIT license İ mit license"])
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (4, 0, 6, "apache,cc-by")
    assert [got[i]["n_base"] for i in (1, 2, 3)] == [0, 0, 0] and got[2]["n_words"] == 0 and got[2]["labels"] == "" and got[2]["score"] == 0
    assert (got[4]["n_base"], got[4]["last_word"]) == (2, 3)


@pytest.mark.parametrize("number", range(len(licenses.TEXTS)))
def test_changed_license_texts_are_found(spark, number):
    text, label = licenses.TEXTS[number]
    words, rng = text.split(), random.Random(number)
    inserted = [x for w in words for x in ([w] if rng.random() > 0.03 else [w, "additional"])]
    dropped = [w for i, w in enumerate(words) if i != len(words) // 2]
    noise = [f"w{rng.randrange(500)}" for _ in range(400)]
    got = scanned(spark, [" ".join(noise + words + noise), " ".join(noise[:50] + inserted + noise), " ".join(dropped), " ".join(noise + words[: len(words) // 3] + noise), " ".join(rng.sample(words, len(words)))])
    for i in (0, 1, 2):
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= licenses.COVER
    texts = {x for _, x in licenses.TEXTS} - {x for _, x in (*licenses.BASE, *licenses.PHRASES)}
    assert not texts & set(got[3]["labels"].split(",")) and not texts & set(got[4]["labels"].split(","))


def test_equal_hashes_of_other_words_do_not_vote(spark):
    docs = spark.createDataFrame([(1, "mit license"), (2, "license mit license mit")], "doc_id long, text string")
    got = {(r["doc_id"], r["start"], r["end"], r["label"]) for r in licenses.license_spans(docs).where("label is not null").collect()}
    assert got == {(1, 0, 2, "mit"), (2, 1, 3, "mit")}


def test_one_shuffle_of_votes_and_no_text(spark):
    plan = licenses.votes(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan and "Cartesian" not in plan
