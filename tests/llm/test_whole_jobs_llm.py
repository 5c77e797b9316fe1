"""Corpus operators' jobs done whole: what a review found cut."""

import random
import string

import pytest

import corpus_pipeline
from leafmend.llm import secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_long_secrets():
    r = random.Random(7)
    for n in (257, 5000):
        v = "".join(r.choices(string.ascii_letters + string.digits + "!%^*", k=n))
        for text in (f"auth: {v} end", f'auth: "{v}" end', f"auth: '{v}' end"):
            assert secrets.redact(text, secrets.find(text)) == text.replace(v, "[SECRET]")
    assert secrets.find(f'auth: "{"z" * 5000}"') == [] and secrets.guess_cost("qw" * 30_000, most=10.0) < 10
    text = f"auth: {v}{'0123456789abcdef' * 2} end"
    assert secrets.redact(text, secrets.find(text)) == "auth: [SECRET][SECRET] end"


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{i * i}" for i in range(60)) for x in ("apple", "brick", "cloud"))
    rows = [(5, a), (5, a), (None, a), (7, b), (7, c), (3, c), (None, "lone words of no other kind"), (9, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_copies_out(spark, docs, SF)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(5, a), (7, b), (3, c), (None, "lone words of no other kind"), (9, None)], key=str)


def test_insults_of_any_person_count():
    for text in ("You are stupid", "he is such a moron", "a\nyou're pathetic", '"They are idiots"'):
        assert toxicity.voted(text.lower(), text)[0] == 1
    assert toxicity.voted("he is here", "He is here")[0] == 0

